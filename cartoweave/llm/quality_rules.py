"""Operator 8: line-first quality rules.

Every line is judged on its own.  It fails
* by punctuation: many signs that are no prose; ten words or more without a sentence's end; a
  teaser, of few words, that ends in an ellipsis; mostly capitals, of any script;
* as navigation: items between bars, dots or arrows; a short item after a bullet;
* as boilerplate: a short line with a phrase of licences, notices, cookies or sign-ups, in one
  of six languages.
Failing lines are removed; a document that loses more than a share of its words is rejected,
as is one that fails the base counts (under 50 words, or over half of its words in 3-word
windows that repeat).

One pass of mapInArrow without a shuffle: a text of any length is read once, and memory is a
batch.  Null and empty texts have no words, fail the base and are rejected.  Repeated rows
and equal ids give one result row each; columns other than doc_id and text are not read, so
their names cannot clash.  An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from cartoweave.llm.common import BLANKS, sliced, table

SYMBOLS = "#*$%&|<>"
#: Symbols that the punctuation rule counts, besides exclamation marks.
MARKS = "#*$%&<>^~{}\\!"
#: What ends a sentence, in any script (Latin, Armenian, Arabic, Syriac, Indic, Burmese, Ethiopic, Khmer, Mongolian, CJK), and what stands between the items of a menu.
ENDS = ".!?\u2026\u203c\u203d\u2047\u2048\u2049" "\u0589\u061d\u061e\u061f\u06d4\u0700\u0701\u0702\u0964\u0965\u104a\u104b\u1362\u1367\u1368\u17d4\u17d5\u1803\u1809\u3002\uff01\uff0e\uff1f\uff61"
BETWEEN = "|\u2022\u00b7\u00bb\u203a"
BULLET = "^[ \\t]*[-\u2013\u2014*\u2022\u25aa\u25e6\u2023\u25cf\u25cb][ \\t]"
ELLIPSIS = "(\\.\\.\\.|\u2026)[ \\t\\r]*$"
#: Words of a line that must have a sentence's end, and at most of an item after a bullet.
PROSE_WORDS, ITEM_WORDS = 10, 5
#: Lines of at most BOILER_WORDS words with one of these are boilerplate.
BOILER = "|".join((
    "all rights reserved", "licensed under", "copyright", "cookie", "privacy policy", "terms of (use|service)", "click here", "sign up", "subscribe", "javascript", "log in to", "share this",
    "alle rechte vorbehalten", "datenschutz", "impressum", "hier klicken", "newsletter",
    "tous droits r\u00e9serv\u00e9s", "mentions l\u00e9gales", "politique de confidentialit\u00e9", "cliquez ici",
    "todos los derechos reservados", "pol\u00edtica de privacidad", "aviso legal", "haga clic",
    "tutti i diritti riservati", "todos os direitos reservados",
))
BOILER_WORDS = 25
LOST_PERCENT = 30

_UPPER, _END, _BULLET, _ELLIPSIS = regex.compile(r"\p{Lu}"), re.compile(f"[{ENDS}]"), re.compile(BULLET), re.compile(ELLIPSIS)
_BOILER = re.compile(BOILER, re.IGNORECASE)


def line_fails(line: str, n_words: int) -> bool:
    """The rules for one line; a line without words never fails."""
    if not n_words:
        return False
    chars = len(line) - sum(map(line.count, BLANKS))
    marks = sum(map(line.count, MARKS))
    between = sum(map(line.count, BETWEEN))
    if marks >= 5 and 10 * marks > chars:
        return True
    if between >= 3 and 10 * between > n_words:
        return True
    if chars >= 20 and 2 * len(_UPPER.findall(line)) > chars:
        return True
    ends = _END.search(line) is not None
    if not ends and (n_words >= PROSE_WORDS or n_words <= ITEM_WORDS + 1 and _BULLET.match(line)):
        return True
    return n_words <= BOILER_WORDS and (_ELLIPSIS.search(line) is not None or _BOILER.search(line) is not None)


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more, the first find included."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    # a pair's number, and a window's from that and the third word: exact, as both are less than n
    pairs = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)[1]
    _, window, counts = np.unique(pairs * n + ids[2:], return_inverse=True, return_counts=True)
    covered = np.zeros(n, bool)
    at = np.flatnonzero(counts[window] > 1)
    for k in range(3):
        covered[at + k] = True
    return int(covered.sum())


def judge(text: str | None, lost_percent: int = LOST_PERCENT) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, words_lost, cleaned)."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = text.split("\n")
    full = [x for x in lines if x.strip(BLANKS)]
    repeated = repeat_words(words)
    base_failed = n < 50 or 100 * repeated > 50 * n
    stay, lost = [], 0
    for line in lines:
        k = len(line.encode("utf-8", "surrogatepass").split())
        if line_fails(line, k):
            lost += k
        else:
            stay.append(line)
    kept = not base_failed and 100 * lost <= lost_percent * n
    return n, chars, sum(map(text.count, SYMBOLS)), len(full) - len(set(full)), repeated, base_failed, kept, lost, "\n".join(stay)


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = f"doc_id long, {' long, '.join(_FIELDS)} long, base_failed boolean, kept boolean, n_words_lost long"


def quality_rules(docs: DataFrame, lost_percent: int = LOST_PERCENT, with_text: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): counts, verdict, words lost and, if asked, the cleaned text."""

    def run(batches):
        for b in sliced(batches):
            rows = [judge(t, lost_percent) for t in b.column("text").to_pylist()]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 9
            out = [b.column("doc_id").cast(pa.int64()), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.bool_()) for c in cols[5:7]), pa.array(cols[7], pa.int64())]
            names = ["doc_id", *_FIELDS, "base_failed", "kept", "n_words_lost"]
            if with_text:
                out, names = [*out, pa.array(cols[8], pa.string())], [*names, "cleaned"]
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA + ", cleaned string" * with_text)


def clean(docs: DataFrame, lost_percent: int = LOST_PERCENT) -> DataFrame:
    """The kept rows of docs with all their columns; text without failing lines, n_chars (if there) its code points."""
    names = docs.columns
    others = [n for n in names if n not in ("text", "n_chars")]

    def run(batches):
        for b in sliced(batches):
            rows = [judge(t, lost_percent) for t in b.column("text").to_pylist()]
            at = pa.array([i for i, r in enumerate(rows) if r[6]], pa.int64())
            texts = [r[8] for r in rows if r[6]]
            cols = {n: b.column(n).take(at) for n in others} | {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    schema = ", ".join(f"`{f.name}` {'long' if f.name == 'n_chars' else f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, schema)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


_W = r"[^\x20\x09-\x0D]+"
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{_W}') AS ws FROM d),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
lw AS (SELECT r, line, len(regexp_extract_all(line, '{_W}')) AS k, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
  length(regexp_replace(line, '[^#*$%&<>^~{{}}\\!]', '', 'g')) AS marks, length(regexp_replace(line, '[^{BETWEEN}]', '', 'g')) AS between_,
  length(regexp_replace(line, '\P{{Lu}}', '', 'g')) AS up, regexp_matches(line, '[{ENDS}]') AS ends FROM lines),
lf AS (SELECT r, line, k, k > 0 AND ((marks >= 5 AND 10 * marks > chars) OR (between_ >= 3 AND 10 * between_ > k) OR (chars >= 20 AND 2 * up > chars)
  OR (NOT ends AND (k >= {PROSE_WORDS} OR (k <= {ITEM_WORDS + 1} AND regexp_matches(line, '{BULLET}'))))
  OR (k <= {BOILER_WORDS} AND (regexp_matches(line, '{ELLIPSIS}') OR regexp_matches(line, '(?i){BOILER}')))) AS bad FROM lw),
ls AS (SELECT r, coalesce(sum(k) FILTER (WHERE bad), 0)::BIGINT AS lost,
  (count(*) FILTER (WHERE k > 0) - count(DISTINCT line) FILTER (WHERE k > 0))::BIGINT AS dups FROM lf GROUP BY r),
g AS (SELECT r, unnest(range(1, greatest(len(ws) - 1, 1))) AS i, ws FROM w),
gr AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM g),
cov AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM gr WHERE c > 1) GROUP BY r),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, dups AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words, lost AS n_words_lost
  FROM d JOIN w USING (r) JOIN ls USING (r) LEFT JOIN cov USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_words_lost <= {LOST_PERCENT} * n_words) AS kept, n_words_lost FROM m
"""
