"""Names: syllables, Markov chains, walks, suffixes."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VOWELS = "aeiou"
#: A syllable: what stands before the vowels, the vowels, and consonants that end the word or come two at a time after l, r, n.
SYLLABLE = rf"[^{VOWELS}]*[{VOWELS}]+(?:[lrn][^{VOWELS}](?=[^{VOWELS}])|[^{VOWELS}]+$)?|[^{VOWELS}]+$"
#: Transitions (base, syllable, next, count) that one worker may hold.
CHAIN_ROWS = 2_000_000
#: Groups of the rows of one base, where chains are larger.
SALTS = 16


def split_names(bases: DataFrame, sep: str = ",") -> DataFrame:
    """base, name: the names of lists (base, names) joined by sep, without outer blanks and empties."""
    return bases.select("base", F.explode(F.split("names", re.escape(sep))).alias("name")).select("base", F.trim("name").alias("name")).where("name <> ''")


def syllables(name: Column) -> Column:
    return F.regexp_extract_all(F.lower(name), F.lit(f"({SYLLABLE})"), F.lit(1))


def transitions(names: DataFrame, split: Column | None = None) -> DataFrame:
    """base, prev, next, n: how often a syllable follows another one; '' is the beginning and the end."""
    s = names.select("base", (syllables(F.col("name")) if split is None else split).alias("s")).where(F.size("s") > 0)
    chain = s.select("base", F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), "s").alias("prev"), F.concat("s", F.array(F.lit(""))).alias("next"))).alias("t"))
    return chain.groupBy("base", F.col("t.prev").alias("prev"), F.col("t.next").alias("next")).agg(F.count("*").alias("n"))


def _drawn(seed: int, base, ident, number: int) -> int:
    """A whole number 0..65535 for each draw, by arithmetic that any SQL engine repeats; bases and ids are whole numbers."""
    a = ((int(ident) * 421 + number) * 48271 + seed + int(base)) % 2147483647
    return a * 16807 % 2147483647 // 7 % 65536


class Walker:
    """Walks over the chains of some bases; rows of a chain: base, prev, next, n."""

    def __init__(self, chain, shortest: int, longest: int, seed: int):
        self.shortest, self.longest, self.seed = shortest, longest, seed
        self.ways: dict = defaultdict(lambda: ([], []))
        for base, prev, nxt, n in sorted(chain):
            options, upto = self.ways[base, prev]
            options.append(nxt)
            upto.append((upto[-1] if upto else 0) + n)
        self.ways = dict(self.ways)

    def name(self, ident, base) -> str:
        draws = 0
        for _ in range(20):
            word, now = "", ""
            for _ in range(20):
                if (base, now) not in self.ways:
                    break
                options, upto = self.ways[base, now]
                draws += 1
                now = options[bisect_right(upto, _drawn(self.seed, base, ident, draws) % upto[-1])]
                if not now or len(word) + len(now) > self.longest:
                    break
                word += now
            if self.shortest <= len(word) <= self.longest:
                return word
        options = self.ways.get((base, ""), ([""], [1]))[0]
        return next((o for o in options if self.shortest <= len(o) <= self.longest), options[0])

    def named(self, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": rows["id"], "base": rows["base"], "name": [self.name(i, k) for i, k in zip(rows["id"], rows["base"], strict=True)]})


def walk_names(rows: DataFrame, chain: DataFrame, shortest: int = 4, longest: int = 12, seed: int = 1) -> DataFrame:
    """rows (id, base: whole numbers) with `name`: a random walk over the chain, from a seed of its own for each id, so it is repeatable.

    After 20 failed walks the first fitting or else the first syllable of the base stands in.
    Chains of up to CHAIN_ROWS rows are sent to the workers; larger ones meet the rows by base,
    those of one base in SALTS groups, each with the base's chain.
    """
    schema = rows.select("id", "base").schema.add("name", "string")
    chain = chain.select("base", "prev", "next", "n")
    if chain.limit(CHAIN_ROWS + 1).count() <= CHAIN_ROWS:
        walker = Walker([tuple(r) for r in chain.collect()], shortest, longest, seed)

        def run(batches):
            for b in batches:
                yield walker.named(b)

        return rows.select("id", "base").mapInPandas(run, schema)

    def meet(own: pd.DataFrame, ways: pd.DataFrame) -> pd.DataFrame:
        return Walker(list(ways[["base", "prev", "next", "n"]].itertuples(index=False, name=None)), shortest, longest, seed).named(own)

    dealt = rows.select("id", "base", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    copies = chain.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return dealt.groupBy("base", "salt").cogroup(copies.groupBy("base", "salt")).applyInPandas(meet, schema)


def tidy(name: Column) -> Column:
    """No signs at the end, no doubled letters, a capital at the beginning of each part."""
    n = F.regexp_replace(F.trim(name), r"[' -]+$", "")
    return F.initcap(F.regexp_replace(n, r"(.)\1+", "$1"))


def with_suffix(name: Column, suffix: Column) -> Column:
    """name and suffix; of two vowels that meet the name's goes."""
    clash = F.lower(F.substring(name, -1, 1)).isin(*VOWELS) & F.lower(F.substring(suffix, 1, 1)).isin(*VOWELS)
    return F.concat(F.when(clash, F.regexp_replace(name, ".$", "")).otherwise(name), suffix)


def state_name(name: Column) -> Column:
    """No blanks, no town endings."""
    n = F.regexp_replace(name, " ", "")
    n = F.when((F.length(n) > 6) & n.endswith("berg"), F.regexp_replace(n, "berg$", "")).otherwise(n)
    return F.when((F.length(n) > 5) & n.endswith("ton"), F.regexp_replace(n, "ton$", "")).otherwise(n)


def code(name: Column) -> Column:
    """Two letters: initials of two parts, or the first two letters."""
    parts = F.split(name, " ")
    return F.upper(F.when(F.size(parts) > 1, F.concat(F.substring(F.get(parts, F.lit(0)), 1, 1), F.substring(F.get(parts, F.lit(1)), 1, 1))).otherwise(F.substring(name, 1, 2)))


def hex_mix(a: Column, b: Column, share: float) -> Column:
    """Channel-wise mix of two colours '#rrggbb'."""
    channel = lambda c, i: F.conv(F.substring(c, 2 + 2 * i, 2), 16, 10).cast("int")
    mixed = [F.lower(F.lpad(F.hex(F.floor(channel(a, i) * (1 - share) + channel(b, i) * share + 0.5).cast("int")), 2, "0")) for i in range(3)]
    return F.concat(F.lit("#"), *mixed)


def numbered(names: DataFrame) -> DataFrame:
    """base, name, place: distinct names of each base in order."""
    return names.distinct().withColumn("place", F.row_number().over(Window.partitionBy("base").orderBy("name")))


def _let(body, **values: Column) -> Column:
    """body(struct of values) with each value computed once, however often the body names it."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body), F.lit(0))


def _hsv(colour: Column) -> Column:
    """struct<h,s,v>"""
    channel = lambda i: F.conv(F.substring(colour, 2 + 2 * i, 2), 16, 10).cast("int") / F.lit(255.0)

    def turn(c):
        r, g, b, most, span = c["r"], c["g"], c["b"], c["most"], F.nullif(c["most"] - c["least"], F.lit(0.0))
        h = F.when(span.isNull(), 0.0).when(r == most, (g - b) / span / 6).when(g == most, (2 + (b - r) / span) / 6).otherwise((4 + (r - g) / span) / 6)
        return F.struct(h.alias("h"), F.coalesce(span / most, F.lit(0.0)).alias("s"), most.alias("v"))

    extremes = lambda c: F.struct(c["r"], c["g"], c["b"], F.greatest(c["r"], c["g"], c["b"]).alias("most"), F.least(c["r"], c["g"], c["b"]).alias("least"))
    rgb = _let(extremes, r=channel(0), g=channel(1), b=channel(2))
    return _let(lambda t: F.struct((t["t"]["h"] - F.floor(t["t"]["h"])).alias("h"), t["t"]["s"].alias("s"), t["t"]["v"].alias("v")), t=_let(lambda c: turn(c["c"]), c=rgb))


def hsv_mix(a: Column, b: Column, share: float, brighter: float = 0.0) -> Column:
    """Two colours '#rrggbb' mixed by hue (the shorter way round), saturation and value, `share` of the first; brighter from -1 to 1."""

    def mixed(c):
        a, b = c["a"], c["b"]
        apart = F.abs(a["h"] - b["h"]) > 0.5
        h = F.when(apart & (a["h"] <= b["h"]), a["h"] + 1).otherwise(a["h"]) * share + F.when(apart & (a["h"] > b["h"]), b["h"] + 1).otherwise(b["h"]) * (1 - share)
        s, v = a["s"] * share + b["s"] * (1 - share), a["v"] * share + b["v"] * (1 - share)
        if brighter > 0:
            v, s = F.least(F.lit(1.0), v * (1 + brighter)), F.greatest(F.lit(0.1), s * (1 - brighter * 0.2))
        elif brighter < 0:
            v, s = F.greatest(F.lit(0.1), v * (1 + brighter)), F.least(F.lit(1.0), s * (1 - brighter * 0.2))
        return F.struct(h.alias("h"), s.alias("s"), v.alias("v"))

    def sextants(c):
        i, f, s, v = F.floor(c["x"]) % 6, c["x"] - F.floor(c["x"]), c["s"], c["v"]
        return F.struct(i.alias("i"), v.alias("v"), (v * (1 - s)).alias("p"), (v * (1 - s * f)).alias("q"), (v * (1 - s * (1 - f))).alias("t"))

    def spelled(c):
        ways = F.array(*[F.array(*[c[k] for k in way]) for way in ("vtp", "qvp", "pvt", "pqv", "tpv", "vpq")])
        signs = F.transform(F.element_at(ways, (c["i"] + 1).cast("int")), lambda x: F.lower(F.lpad(F.hex(F.floor(x * 255).cast("int")), 2, "0")))
        return F.concat(F.lit("#"), F.array_join(signs, ""))

    mix = _let(mixed, a=_hsv(a), b=_hsv(b))
    six = _let(lambda m: F.struct(((m["m"]["h"] - F.floor(m["m"]["h"])) * 6).alias("x"), m["m"]["s"].alias("s"), m["m"]["v"].alias("v")), m=mix)
    return _let(lambda c: spelled(c["c"]), c=_let(lambda x: sextants(x["x"]), x=six))


def places(name: Column, ident: Column) -> dict[str, Column]:
    """Names made from one: land, town, river, mountain, and a full title, whose form the id picks."""
    title = F.when(ident % 3 == 0, F.concat(F.lit("Kingdom of "), name)).when(ident % 3 == 1, F.concat(name, F.lit(" Republic"))).otherwise(F.concat(F.lit("Grand Duchy of "), name))
    return {"land": with_suffix(name, F.lit("ia")), "burg": with_suffix(name, F.lit("ton")), "river": F.concat(name, F.lit(" River")), "mountain": F.concat(F.lit("Mount "), name), "title": title}
