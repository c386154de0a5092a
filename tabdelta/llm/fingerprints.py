"""Document fingerprints by I-Match with randomised lexicons.

The lexicon keeps the terms whose inverse document frequency lies in a band: words that
most documents share say nothing, words that hardly any other has change with every slip.
A text is reduced to its distinct lexicon terms, sorted.  One hash of them all breaks with a single
changed term, so several random subsets of the lexicon are hashed instead, each on its own:
a subset that holds a share p of the lexicon keeps its hash after d changed terms with a chance of
(1 - p) ** d.  Shares fall in powers of two, so that some subsets fit a text of any size.

All of it is DataFrame functions.  The lexicon is broadcast: a term in at least 2 ** -HIGH of all
documents is one of at most 2 ** HIGH times the mean number of terms of a document, whatever the corpus.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkit import let

#: Band of log2(documents / documents with the term).
LOW, HIGH = 3.0, 9.0
#: Log2 of one over the share of the lexicon that a subset holds; the first holds it all.
LEVELS = (0, 2, 3, 4, 4, *(level for level in range(5, 10) for _ in range(8)))
#: Bytes of text in a range of ids, about, and sampled ids for each range.
RANGE_BYTES = 128 << 20
PER_RANGE = 20

BAND, COMMON, EXACT = "b", "c", "="


def terms(text: Column) -> Column:
    """Distinct terms of a text: what stands between ASCII characters that are no letters or digits, in lower case."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[\x00-/:-@\[-`{-\x7F]+")), "")


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """``term, mask, common`` of the terms in ``2 ** -high`` of all documents or more.

    ``term`` is a hash; bit k of ``mask`` says whether subset k holds the term; ``common`` terms lie
    below the band.  Documents with a null text count as documents.
    """
    sets = docs.select(F.explode(F.transform(F.array_append(terms(F.coalesce(text_col, F.lit(""))), ""), lambda t: F.xxhash64(t))).alias("term"))
    counts = sets.groupBy("term").agg(F.count("*").alias("n"))
    every = F.xxhash64(F.lit(""))
    saved = Scratch(docs.sparkSession, "fingerprints").save(counts)
    total = saved.where(F.col("term") == every).select("n").first()
    documents = total[0] if total else 0
    mask = F.lit(0).cast("long")
    for k, level in enumerate(LEVELS):
        inside = F.pmod(F.xxhash64(F.lit(k), "term"), F.lit(1 << level)) == 0
        mask = mask.bitwiseOR(F.when(inside, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")))
    held = saved.where((F.col("term") != every) & (F.col("n") >= documents / 2**high))
    return held.select("term", mask.alias("mask"), (F.col("n") > documents / 2**low).alias("common"))


def _slots(found: Column) -> Column:
    """Hash of each subset's terms, or an empty text; ``found`` holds ``term, mask`` in order."""
    bits = F.array(*[F.lit(1 << k).cast("long") for k in range(len(LEVELS))])

    def slot(bit: Column) -> Column:
        own = F.transform(F.filter(found, lambda x: x["mask"].bitwiseAND(bit) != 0), lambda x: x["term"])
        return let(own, lambda t: F.when(F.size(t) > 0, F.right(F.lpad(F.hex(F.xxhash64(t)), 16, "0"), F.lit(8))).otherwise(""))

    return F.array_join(F.transform(bits, slot), ".")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal hashes among the subsets of which either text has a term; 1 for equal fingerprints."""
    x, y = F.split(F.substring(a, 3, 1 << 20), r"\."), F.split(F.substring(b, 3, 1 << 20), r"\.")
    equal = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p == q) & (p != "")), lambda e: e))
    either = F.size(F.filter(F.zip_with(x, y, lambda p, q: (p != "") | (q != "")), lambda e: e))
    unlike = (F.left(a, F.lit(1)) != F.left(b, F.lit(1))) | F.startswith(a, F.lit(EXACT))
    return F.when(a == b, 1.0).when(unlike, 0.0).otherwise(equal / either)


def fingerprints(docs: DataFrame, words: DataFrame, keys: list[str], texts: list[str]) -> DataFrame:
    """All columns of ``docs``, with a fingerprint in the place of each column of ``texts``.

    ``keys`` tell the rows apart; if ``docs`` is dealt out by some of them, nothing is shuffled.  Null
    texts are taken as empty.  Texts that are equal get equal fingerprints.
    """
    sides = range(len(texts))
    others = [c for c in docs.columns if c not in keys and c not in texts]
    text = [F.coalesce(t, F.lit("")) for t in texts]
    lists = [F.transform(terms(t), lambda x: F.xxhash64(x)).alias(f"_terms{k}") for k, t in zip(sides, text, strict=True)]
    whole = F.struct(*others, *[F.xxhash64(t).alias(f"_exact{k}") for k, t in zip(sides, text, strict=True)])
    rows = docs.select(*keys, whole.alias("whole"), *lists)
    # what belongs to a row as a whole goes with the first place only, the terms of each text follow
    ends = [sum((F.size(f"_terms{j}") for j in range(k + 1)), F.lit(0)).alias(f"_end{k}") for k in sides]
    spread = rows.select(*keys, "whole", *ends, F.posexplode(F.concat(F.array(F.lit(None).cast("long")), *[f"_terms{k}" for k in sides])).alias("pos", "term"))
    which = F.when(F.col("pos") == 0, -1)
    for k in sides:
        which = which.when(F.col("pos") <= F.col(f"_end{k}"), k)
    spread = spread.select(*keys, "term", which.alias("which"), F.when(F.col("pos") == 0, F.col("whole")).alias("whole"))
    met = spread.join(F.broadcast(words), "term", "left").where("common IS NOT NULL OR whole IS NOT NULL")
    own = F.struct("common", "term", "mask")
    held = met.groupBy(*keys).agg(
        F.first("whole", ignorenulls=True).alias("whole"), *[F.array_sort(F.collect_list(F.when(F.col("which") == k, own))).alias(f"_held{k}") for k in sides]
    ).select(*keys, "whole.*", *[f"_held{k}" for k in sides])

    def chosen(k: int) -> list[Column]:
        """Terms in the band; without any, the common ones; without these, the text as it is."""
        terms_of = F.col(f"_held{k}")
        common = F.element_at(terms_of, 1)["common"]
        kind = F.when(F.size(terms_of) == 0, EXACT).when(common, COMMON).otherwise(BAND)
        return [kind.alias(f"_kind{k}"), F.filter(terms_of, lambda x: x["common"] == common).alias(f"_own{k}"), F.hex(f"_exact{k}").alias(f"_exact{k}")]

    held = held.select(*keys, *others, *[x for k in sides for x in chosen(k)])
    made = [F.when(F.col(f"_kind{k}") == EXACT, F.concat(F.lit(EXACT), f"_exact{k}")).otherwise(F.concat(f"_kind{k}", F.lit(":"), _slots(F.col(f"_own{k}")))) for k in sides]
    return held.select(*keys, *others, *[made[k].alias(t) for k, t in enumerate(texts)])


# the document after each -------------------------------------------------------------


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``range, place, guest, doc, text, next_text``: each document with the text of the one after it by id; after the last comes the first.

    Documents go to ranges of ids; the first of each range is also a guest of the range before, so one
    shuffle brings every pair together and no range waits for another.  ``place`` counts within a range,
    guests last.  Rows of one id follow each other by a hash of their texts.  A null id comes
    first, null texts are empty.
    """
    keyed = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("check", F.xxhash64("text"))
    key = F.struct("doc", "check")
    firsts, kind = _range_starts(keyed, key)
    n = len(firsts)
    bounds = F.from_json(F.lit(json.dumps(firsts, default=str)), f"array<{kind}>") if n else F.array(key)
    # the last start that isn't after the key, by halving
    steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, n).bit_length()))])
    at = F.aggregate(steps, F.lit(0), lambda low, step: F.when((low + step <= n) & (F.get(bounds, low + step - 1) <= key), low + step).otherwise(low))
    before = F.when(F.get(bounds, F.col("at") - 1) == key, F.when(F.col("at") > 1, F.col("at") - 1).otherwise(n))
    own = F.struct(F.col("at").alias("range"), F.lit(False).alias("guest"))
    guest = F.when(before.isNotNull(), F.struct(before.alias("range"), F.lit(True).alias("guest")))
    sent = keyed.withColumn("at", at).select(F.inline(F.array_compact(F.array(own, guest))), "doc", "check", "text")
    order = Window.partitionBy("range").orderBy("guest", "doc", "check")
    return sent.select("range", F.row_number().over(order).alias("place"), "guest", "doc", "text", F.lead("text").over(order).alias("next_text"))


def _range_starts(keyed: DataFrame, key: Column) -> tuple[list[dict], str]:
    """Keys at which ranges start, the least of all first, and their type.

    Any keys give right pairs; those of a sample give ranges of much the same size.  What reaches the driver is
    some 16 bytes for each ``RANGE_BYTES / PER_RANGE`` bytes of text.
    """
    least = F.to_json(F.array(F.min(key)), {"ignoreNullFields": "false"})
    size = keyed.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes"), least.alias("least")).first()
    if not size["n"]:
        return [], ""
    kind = keyed.select(key.alias("k")).schema["k"].dataType.simpleString()
    partitions = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(4 * partitions, math.ceil((size["bytes"] or 0) / RANGE_BYTES))
    picked = keyed.select("doc", "check").sample(min(1.0, ranges * PER_RANGE / size["n"]), seed=7).distinct().sort("doc", "check").toArrow()
    first, step = json.loads(size["least"])[0], max(1, len(picked) // ranges)
    later = picked.take(pa.array(range(step, len(picked), step), pa.int64())).to_pylist()
    return [first, *(x for x in later if x != first)], kind


def edited(text: Column, after: Column) -> Column:
    """``text`` with its last half of code points, rounded down, replaced by as many (or all) from the start of ``after``."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(after, F.lit(1), half))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of documents and of edited texts, and how alike they and the next documents' are.

    Each row of ``docs`` gets one row, repeated rows and rows with a null id too; null ids come first
    and null texts are empty.  Equal texts have equal fingerprints, two empty ones too, and a document
    alone in its table is the one after itself.  Further columns of ``docs`` are ignored; an empty
    table gives an empty result.
    """
    words = Scratch(docs.sparkSession, "fingerprints").save(lexicon(docs, text_col))
    changed = F.when(~F.col("guest"), edited(F.col("text"), F.col("next_text")))
    rows = with_next(docs, id_col, text_col).withColumn("edited", changed)
    rows = rows.select("range", "place", "guest", "doc", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "text", "edited")
    made = fingerprints(rows, words, ["range", "place"], ["text", "edited"])
    after = made.withColumn("after", F.lead("text").over(Window.partitionBy("range").orderBy("place"))).where(~F.col("guest"))
    return after.select(
        F.col("doc").alias(id_col), "n_chars", "edited_sha256", F.col("text").alias("fingerprint"), F.col("edited").alias("edited_fingerprint"),
        likeness(F.col("text"), F.col("edited")).alias("near_edited"), likeness(F.col("text"), F.col("after")).alias("near_next"),
    )
