"""The ratio of matching blocks of two texts, order-sensitive, as a Column expression.

The longest common run is taken (of several the first in ``a``, then in ``b``), then the same left and right of it. The pairs of
pieces that are still to be compared are a stack inside one ``aggregate``; another one finds the longest run in as many
steps as both texts have letters: it lengthens the run while the other text holds it, else it moves on by a letter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriframe.functions import text as T

#: In a second text of this length or more, letters that make up more than a hundredth of it (and one more) begin no run.
LONG, SHARE = 200, 100
_HIDDEN = "\x00"
_PIECES = "array<struct<a:string,b:string,m:string>>"


def _longest(a: Column, b: Column) -> Column:
    """Start (from 1) and length of the longest run of a that b holds, the first of several."""
    made = lambda i, n, at: F.struct(i.alias("i"), n.alias("n"), at.alias("at"))

    def step(s: Column, _: Column) -> Column:
        longer = made(s["i"], s["n"] + 1, s["i"])
        return F.when(s["i"] + s["n"] > F.length(a), s).when(F.contains(b, F.substring(a, s["i"], s["n"] + 1)), longer).otherwise(made(s["i"] + 1, s["n"], s["at"]))

    steps = F.sequence(F.lit(1), F.length(a) + F.least(F.length(a), F.length(b)))
    return F.aggregate(steps, made(F.lit(1), F.lit(0), F.lit(1)), step)


def _alike(a: Column, b: Column, most: Column, at: int) -> Column:
    """Letters that a and b have in common from their start (at = 1) or their end (at = -1) on."""
    letter = lambda x, n: F.substring(x, n + 1, F.lit(1)) if at > 0 else F.substring(x, -n - 1, F.lit(1))
    return F.aggregate(F.sequence(F.lit(1), most + 1), F.lit(0), lambda n, _: F.when((n < most) & (letter(a, n) == letter(b, n)), n + 1).otherwise(n))


def _split(p: Column) -> Column:
    """Letters that match in a pair of pieces, and the pieces left and right of them."""
    tail = lambda x, n: F.substring(x, n, F.length(x))

    def placed(f: Column) -> Column:
        return F.struct(f["at"].alias("i"), F.when(f["n"] == 0, 1).otherwise(F.instr(p["m"], F.substring(p["a"], f["at"], f["n"]))).alias("j"), f["n"].alias("n"))

    def grown(f: Column) -> Column:
        """Runs grow over letters that may not begin one."""
        before = lambda x, at: F.substring(x, F.lit(1), at - 1)
        hidden = p["m"] != p["b"]
        left = F.when(hidden, _alike(before(p["a"], f["i"]), before(p["b"], f["j"]), F.least(f["i"], f["j"]) - 1, -1)).otherwise(0)
        after = F.least(F.length(p["a"]) - f["i"], F.length(p["b"]) - f["j"]) + 1 - f["n"]
        right = F.when(hidden, _alike(tail(p["a"], f["i"] + f["n"]), tail(p["b"], f["j"] + f["n"]), after, 1)).otherwise(0)
        return F.struct((f["i"] - left).alias("i"), (f["j"] - left).alias("j"), (f["n"] + left + right).alias("n"))

    def pieces(f: Column) -> Column:
        one = F.struct(*[F.substring(p[x], F.lit(1), f[k] - 1).alias(x) for x, k in (("a", "i"), ("b", "j"), ("m", "j"))])
        two = F.struct(*[tail(p[x], f[k] + f["n"]).alias(x) for x, k in (("a", "i"), ("b", "j"), ("m", "j"))])
        more = F.filter(F.array(one, two), lambda x: (x["a"] != "") & (x["b"] != ""))
        return F.struct(f["n"].alias("n"), F.when(f["n"] > 0, more).otherwise(F.array().cast(_PIECES)).alias("more"))

    return T.let(T.let(T.let(_longest(p["a"], p["m"]), placed), grown), pieces)


def _masked(b: Column) -> Column:
    """b with its frequent letters hidden, if it is long."""
    often = lambda c: F.length(b) - F.length(F.replace(b, c, F.lit(""))) > F.floor(F.length(b) / SHARE) + 1
    shown = F.array_join(F.transform(F.split(b, ""), lambda c: F.when((c != "") & often(c), _HIDDEN).otherwise(c)), "")
    return F.when(F.length(b) >= LONG, shown).otherwise(b)


def ratio(a: Column, b: Column) -> Column:
    """Twice the letters in matching blocks over all letters; 0 if either text is empty, null if either is null."""

    def step(s: Column, _: Column) -> Column:
        rest = F.slice(s["todo"], F.lit(1), F.size(s["todo"]) - 1)
        taken = lambda x: F.struct(F.concat(rest, x["more"]).alias("todo"), (s["n"] + x["n"]).alias("n"))
        return F.when(F.size(s["todo"]) == 0, s).otherwise(T.let(_split(F.element_at(s["todo"], -1)), taken))

    def measured(x: Column) -> Column:
        both = F.struct(x["a"].alias("a"), x["b"].alias("b"), _masked(x["b"]).alias("m"))
        start = F.struct(F.array(both).cast(_PIECES).alias("todo"), F.lit(0).alias("n"))
        # a run takes a letter of either text, and leaves two pairs of pieces at most
        steps = F.sequence(F.lit(1), F.least(F.length(x["a"]), F.length(x["b"])) * 2 + 1)
        n = F.aggregate(steps, start, step)["n"]
        share = n * 2 / (F.length(x["a"]) + F.length(x["b"]))
        return F.when(x["a"].isNull() | x["b"].isNull(), None).when((x["a"] == "") | (x["b"] == ""), 0.0).when(x["a"] == x["b"], 1.0).otherwise(share)

    return T.let(F.struct(a.alias("a"), b.alias("b")), measured)


def similarity(claim: Column, read: Column, where: Column) -> Column:
    """Similarity of two brands; null where ``where`` is false, and such rows cost no comparison."""
    return ratio(F.when(where, T.confusion_fold(claim)), F.when(where, T.confusion_fold(read)))
