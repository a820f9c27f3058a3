"""Fill-in-middle: a text is cut in prefix, middle and suffix, and the middle is moved to the end.

Cuts fall between units: runs of ASCII letters, and single characters of any
other kind.  A text's bytes are counted in fixed blocks: units and code points
that begin there.  A Fenwick tree over the blocks answers how many precede one,
and a descent by falling powers of two finds the block in which a given unit
begins, so only that block is looked at to find the exact place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordclips.llm import arrays
from wordclips.llm.catalog import query, table
from wordclips.llm.text import whole

#: Bytes in a block of the tree.
BLOCK = 4096
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts, how many stay plain; of 100 others, how many put the suffix first.
PLAIN, SPM = 10, 20

_LETTER = np.zeros(256, dtype=bool)
_LETTER[ord("A"):ord("Z") + 1] = _LETTER[ord("a"):ord("z") + 1] = True
_KINDS = "n bigint, prefix_chars bigint, middle_chars bigint"


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes of a text begin a code point, and which a unit."""
    point = (data & 0xC0) != 0x80
    letter = _LETTER[data]
    unit = point.copy()
    unit[1:] &= ~(letter[1:] & letter[:-1])
    return point, unit


class Blocks:
    """Counts of units and code points per block of a text, in a Fenwick tree."""

    def __init__(self, data: np.ndarray, size: int = BLOCK):
        self.data, self.size = data, size
        at = np.arange(0, len(data), size)
        point, unit = marks(data)
        counts = [np.add.reduceat(x, at, dtype=np.int64) if len(at) else np.zeros(0, np.int64) for x in (unit, point)]
        self.tree = np.zeros((len(at) + 1, 2), dtype=np.int64)
        self.tree[1:] = np.stack(counts, axis=1)
        step = 1
        while step < len(self.tree):            # nodes that cover 2 * step blocks take in their left half
            node = np.arange(2 * step, len(self.tree), 2 * step)
            self.tree[node] += self.tree[node - step]
            step *= 2
        self.units, self.points = (int(x) for x in self.before(len(at)))

    def before(self, block: int) -> np.ndarray:
        """Units and code points that begin before ``block``."""
        total = np.zeros(2, dtype=np.int64)
        while block:
            total += self.tree[block]
            block &= block - 1
        return total

    def begins(self, unit: int) -> int:
        """How many code points precede ``unit`` (from 0); all of them for the one after the last."""
        if unit >= self.units:
            return self.points
        block, seen = 0, np.zeros(2, dtype=np.int64)
        step = 1 << (len(self.tree) - 1).bit_length()
        while step:
            ahead = block + step
            if ahead < len(self.tree) and seen[0] + self.tree[ahead, 0] <= unit:
                block, seen = ahead, seen + self.tree[ahead]
            step >>= 1
        # The unit begins in this block; one byte more than the block tells whether it begins with a unit.
        lo = block * self.size
        point, begin = marks(self.data[max(0, lo - 1):lo + self.size])
        point, begin = (x[1:] if lo else x for x in (point, begin))
        place = np.flatnonzero(begin)[unit - int(seen[0])]
        return int(seen[1] + point[:place].sum())


def _cut(size: int):
    @F.arrow_udf(_KINDS)
    def cut(texts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for column, one, two in texts:
            found = []
            for data, a, b in zip(arrays.texts(column), one.to_pylist(), two.to_pylist(), strict=True):
                blocks = Blocks(data, size)
                n = blocks.units
                lo, hi = (blocks.begins(x) for x in sorted((a % (n + 1), b % (n + 1))))
                found.append({"n": n, "prefix_chars": lo, "middle_chars": hi - lo})
            yield pa.array(found, pa.struct([(c, pa.int64()) for c in ("n", "prefix_chars", "middle_chars")]))

    return cut


def draws(key: Column | str, salt: str = "1:") -> list[Column]:
    """Four numbers below 2^32 drawn by the SHA-256 of ``salt`` and the decimal key (null: nothing after the salt)."""
    name = (F.col(key) if isinstance(key, str) else key).cast("string")
    hashed = F.sha2(F.concat(F.lit(salt), F.coalesce(name, F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", plain: int = PLAIN, spm: int = SPM,
                   salt: str = "1:", block: int = BLOCK) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and output; other columns stay, equally named ones too.

    ``form`` is plain for an empty or null text, one that holds a sentinel, and
    ``plain`` of 100 others; else spm for ``spm`` of 100, psm for the rest.  The
    output of a plain text is the text (null: empty) and its lengths are null.
    All draws follow from ``key`` alone: rows of one key and text are cut alike.
    An empty table stays empty.
    """
    mine = ("n", "form", "prefix_chars", "middle_chars", "output")
    text, (one, two, three, four) = whole("text"), draws(key, salt)
    marked = F.lit(False)
    for sign in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(sign))
    form = F.when((text == "") | marked | (three % 100 >= 100 - plain), "plain").when(four % 100 < spm, "spm").otherwise("psm")
    rows = docs.select(*docs.columns, text.alias("__text"), form.alias("__form"), _cut(block)(text, one, two).alias("__cut"))
    lo, middle = F.col("__cut.prefix_chars"), F.col("__cut.middle_chars")
    piece = lambda at, n: F.substring("__text", (at + 1).cast("int"), n.cast("int"))
    first, second, third = piece(F.lit(0), lo), piece(lo, middle), piece(lo + middle, F.length("__text"))
    output = F.when(F.col("__form") == "plain", F.col("__text")) \
        .when(F.col("__form") == "psm", F.concat(F.lit(PREFIX), first, F.lit(SUFFIX), third, F.lit(MIDDLE), second)) \
        .otherwise(F.concat(F.lit(SUFFIX), third, F.lit(PREFIX), first, F.lit(MIDDLE), second))
    cut = F.col("__form") != "plain"
    return rows.select(*[F.col(c) for c in docs.columns if c not in mine], F.col("__cut.n").alias("n"), F.col("__form").alias("form"),
                       F.when(cut, lo).alias("prefix_chars"), F.when(cut, middle).alias("middle_chars"), output.alias("output"))


def restored(output: Column | str, form: Column | str) -> Column:
    """The text, rebuilt from an output and its form alone."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    head, middle = F.split_part(output, F.lit(MIDDLE), F.lit(1)), F.split_part(output, F.lit(MIDDLE), F.lit(2))
    psm = F.concat(F.substring(F.split_part(head, F.lit(SUFFIX), F.lit(1)), len(PREFIX) + 1, 2**31 - 1), middle,
                   F.split_part(head, F.lit(SUFFIX), F.lit(2)))
    spm = F.concat(F.split_part(head, F.lit(PREFIX), F.lit(2)), middle,
                   F.substring(F.split_part(head, F.lit(PREFIX), F.lit(1)), len(SUFFIX) + 1, 2**31 - 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


OP11_SQL = f"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS units FROM documents),
drawn AS (
  SELECT *, len(units) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2,
         ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM hashed),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS lo, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS hi,
         CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}')
                OR h3 % 100 >= {100 - PLAIN} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (
  SELECT *, array_to_string(units[1:lo], '') AS prefix, array_to_string(units[lo + 1:hi], '') AS middle,
         array_to_string(units[hi + 1:], '') AS suffix FROM cut)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
         WHEN 'psm' THEN '{PREFIX}' || prefix || '{SUFFIX}' || suffix || '{MIDDLE}' || middle
         ELSE '{SUFFIX}' || suffix || '{PREFIX}' || prefix || '{MIDDLE}' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


@query("op11_fill_in_middle", OP11_SQL)
def op11_fill_in_middle(spark, sf_dir):
    """Contract: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    out = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                      sha(restored("output", "form")).alias("restored_sha256"))
