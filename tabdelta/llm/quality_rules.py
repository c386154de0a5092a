"""Quality rules combined by weak supervision.

Each rule looks at a count of its own and votes good, votes bad or abstains.
Expectation-maximisation estimates without any labels how accurate the votes of each rule
are on good and on bad documents, and every document gets the posterior probability that
it is good.  A rule that says good of nearly everything so has hardly any weight when it does.
Documents that fail the base test are out whatever their votes, so only the others teach.
One pass over the texts makes the counts; EM then needs only how many documents show each
combination of votes, a table of at most 3 ** len(RULES) rows whatever the corpus.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .scratch import Scratch
from .textkit import map_text, window_hashes

#: Characters counted by ``n_symbols``.
SYMBOLS = b"#*$%&|<>"
#: Characters that end a sentence, for the rule on line ends.
TERMINAL = (b".", b"!", b"?", b'"', b":", "…".encode(), "»".encode(), "”".encode())

#: Bytes of letters: A-Z, a-z and all of UTF-8 beyond ASCII.
_LETTERS = bytes([*range(65, 91), *range(97, 123), *range(128, 256)])

COUNTS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_ended_lines long, n_distinct_words long, n_plain_words long"
)
_NAMES = [c.split()[0] for c in COUNTS.split(", ")]


def count_text(text: str | None) -> tuple[int, ...]:
    """The counts named in ``COUNTS`` of one whole text; null counts as empty.

    ``n_repeat_words`` counts the words covered by 3-word windows that the text holds
    twice or more, the first included.  Plain words are letters alone but for marks at the end.
    """
    if not text:
        return (0,) * len(_NAMES)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    raw = np.frombuffer(b"".join(words), np.uint8)
    chars = int(((raw & 0xC0) != 0x80).sum())
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [s for s in (x.strip() and x for x in data.split(b"\n")) if s]
    ended = sum(x.rstrip().endswith(TERMINAL) for x in lines)
    repeated = 0
    if n >= 3:
        hashes = window_hashes(words, 3)
        _, inverse, many = np.unique(hashes, return_inverse=True, return_counts=True)
        hit = many[inverse] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : k + len(hit)] |= hit
        repeated = int(covered.sum())
    times = Counter(words)
    plain = sum(k for w, k in times.items() if not w.rstrip(b".,;:!?").translate(None, _LETTERS))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), ended, len(times), plain


def with_counts(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """Each row of ``docs`` with the counts of its whole text; they replace columns of their names."""
    names = [prefix + n for n in _NAMES]
    base = docs.drop(*names)
    at = base.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [count_text(t) for t in batch.column(at).to_pylist()]
        columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    schema = StructType([*base.schema.fields, *(StructField(n, LongType()) for n in names)])
    return map_text(base, run, schema, text_col)


def _ratio(top: str, bottom: str) -> Column:
    return F.col(top) / F.greatest(F.col(bottom), F.lit(1))


@dataclass(frozen=True)
class Rule:
    """A vote from one ratio: bad or good where the predicates hold, else none."""

    name: str
    bad: Column
    good: Column

    def vote(self) -> Column:
        """0 for bad, 1 for good, 2 for no vote."""
        return F.when(self.bad, 0).when(self.good, 1).otherwise(2)


def default_rules() -> list[Rule]:
    """The rules of the query.  Bounds are shares of words or lines."""
    word = _ratio("word_chars", "n_words")
    symbol = _ratio("n_symbols", "n_words")
    double = _ratio("n_dup_lines", "n_lines")
    repeat = _ratio("n_repeat_words", "n_words")
    ended = _ratio("n_ended_lines", "n_lines")
    variety = _ratio("n_distinct_words", "n_words")
    plain = _ratio("n_plain_words", "n_words")
    return [
        Rule("word_length", (word < 2.5) | (word > 12), (word >= 3) & (word <= 10)),
        Rule("symbols", symbol > 0.1, symbol <= 0.02),
        Rule("duplicate_lines", double > 0.3, double <= 0.05),
        Rule("repeated_words", repeat > 0.3, repeat <= 0.15),
        Rule("ended_lines", (ended < 0.3) & (F.col("n_lines") >= 2), ended > 0.7),
        Rule("word_variety", (F.col("n_words") >= 100) & ((variety > 0.97) | (variety < 0.05)), (variety >= 0.1) & (variety <= 0.9)),
        Rule("plain_words", plain < 0.8, plain > 0.9),
    ]


@dataclass(frozen=True)
class LabelModel:
    """Shares of right votes of each rule on good and on bad documents, and the share of good ones."""

    good: np.ndarray
    bad: np.ndarray
    prior: float


def fit_label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 200, margin: float = 0.05, ceiling: float = 0.99) -> LabelModel:
    """EM over distinct vote combinations (rows of 0, 1 and 2) and their numbers of documents.

    A rule is taken to be better than chance: its two accuracies sum to 1 + ``margin`` at least, and
    on good documents it is right more often than not, so the two classes can't change places.
    EM starts once from accuracies of 0.8 and once from taking documents with a bad vote for
    bad; the outcome under which the votes are likelier counts.
    """
    n_rules = votes.shape[1]
    start = LabelModel(np.full(n_rules, 0.8), np.full(n_rules, 0.8), 0.8)
    if not len(votes):
        return start
    says_good, says_bad = votes == 1, votes == 0

    def of_classes(p: np.ndarray) -> LabelModel:
        w_good, w_bad = p * counts, (1 - p) * counts
        # two pseudo-votes at an accuracy of 0.8 keep rules that rarely vote defined
        good = np.clip((w_good @ says_good + 1.6) / (w_good @ (says_good | says_bad) + 2), 0.5 + margin, ceiling)
        bad = np.clip((w_bad @ says_bad + 1.6) / (w_bad @ (says_good | says_bad) + 2), 1 - good + margin, ceiling)
        return LabelModel(good, bad, float(np.clip(w_good.sum() / counts.sum(), 0.02, 0.98)))

    def logs(m: LabelModel) -> tuple[np.ndarray, np.ndarray]:
        return (
            np.log(m.prior) + says_good @ np.log(m.good) + says_bad @ np.log(1 - m.good),
            np.log(1 - m.prior) + says_good @ np.log(1 - m.bad) + says_bad @ np.log(m.bad),
        )

    best, most = start, -np.inf
    for model in (start, of_classes(np.where(says_bad.any(axis=1), 0.1, 0.9))):
        for _ in range(rounds):
            of_good, of_bad = logs(model)
            model = of_classes(1 / (1 + np.exp(np.clip(of_bad - of_good, -60, 60))))
        likely = float(counts @ np.logaddexp(*logs(model)))
        if likely > most:
            best, most = model, likely
    return best


def base_failed() -> Column:
    """Too few words, or more than half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def learn(counts: DataFrame, rules: list[Rule]) -> LabelModel:
    """Fit the label model to the rows of a table of counts that pass the base test.

    Combinations of votes reach the driver with their numbers of rows.
    """
    names = [r.name for r in rules]
    seen = counts.where(~base_failed()).select(*[r.vote().alias(r.name) for r in rules]).groupBy(*names).count().collect()
    votes = np.array([[r[n] for n in names] for r in seen]).reshape(-1, len(rules))
    return fit_label_model(votes, np.array([r["count"] for r in seen], float))


def verdicts(counts: DataFrame, rules: list[Rule], model: LabelModel, least: float) -> DataFrame:
    """``counts`` with the votes, ``base_failed``, the posterior ``p_quality`` and ``kept``."""
    votes = [r.vote().alias(f"vote_{r.name}") for r in rules]
    odds = F.lit(float(np.log(model.prior / (1 - model.prior))))
    for rule, g, b in zip(rules, model.good, model.bad, strict=True):
        vote = F.col(f"vote_{rule.name}")
        odds = odds + F.when(vote == 1, float(np.log(g / (1 - b)))).when(vote == 0, float(np.log((1 - g) / b))).otherwise(0.0)
    return (
        counts.select("*", *votes, base_failed().alias("base_failed"))
        .withColumn("p_quality", 1 / (1 + F.exp(-odds)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_quality") >= least))
    )


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, least: float = 0.5) -> DataFrame:
    """Id, base counts, ``base_failed`` and ``kept`` of each row of ``docs``; then further counts, votes and ``p_quality``.

    ``base_failed`` marks texts with fewer than 50 words or with more than half of
    their words in repeated 3-word windows; they are never kept.  Others are kept if
    the posterior is ``least`` or more.

    Null and empty texts have no words, so they fail the base test.  Repeated rows and
    rows with a null id each get a row of their own.  An empty table gives an empty
    result.  Further columns of ``docs`` are ignored.
    """
    rules = default_rules() if rules is None else rules
    texts = docs.select(id_col, F.col(text_col).cast("string").alias("text"))
    counts = Scratch(docs.sparkSession, "quality_rules").save(with_counts(texts).drop("text"))
    found = verdicts(counts, rules, learn(counts, rules), least)
    first = [id_col, *_NAMES[:5], "base_failed", "kept"]
    return found.select(*first, *[c for c in found.columns if c not in first])


def keep_good(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns.

    Rows are written once with their counts, so that no text is counted twice or shuffled.
    """
    rules = default_rules() if rules is None else rules
    prefix = "_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    counted = Scratch(docs.sparkSession, "quality_rules").save(with_counts(docs.withColumn(text_col, F.col(text_col).cast("string")), text_col, prefix))
    counts = counted.select(F.struct(*docs.columns).alias(f"{prefix}row"), *[F.col(prefix + n).alias(n) for n in _NAMES])
    return verdicts(counts, rules, learn(counts, rules), least).where("kept").select(f"{prefix}row.*")
