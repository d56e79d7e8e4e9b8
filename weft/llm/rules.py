r"""Quality rules by weak supervision: rules vote or abstain, and what their votes are worth is learned from all documents.

A rule is a pair of conditions over the figures of a text: it votes good (1) where the first holds, bad (-1) where only
the second does, and else abstains (0). Expectation maximisation over the counts of vote patterns of the whole table
estimates how many documents are good and how often each rule votes right on good and on bad ones; no label is used. The
posterior probability of a document to be good then decides, so one failing rule does not reject a document that all others
speak for, and several weak signs together do. A rule is held better than chance, so good and bad cannot change places.

Words are ``[^\x20\x09-\x0D]+``, lines are split at ``\n`` and count if they have a word. A null text is an empty one.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from weft.errors import OpError, need_columns
from weft.llm.common import schema_with, slices, texts_of
from weft.runtime import checkpoint

#: Words of the windows that count as repeated.
WINDOW = 8
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
#: The most rules: patterns of votes (3 to the number of rules) come to the driver.
MOST_RULES = 10
#: What is rejected whatever the rules say.
BASE_FAILED = "n_words < 20 or 100 * n_repeat_words > 30 * n_words"
#: The posterior from which a document stays.
KEEP = 0.5
FIGURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_letter_words", "n_upper", "n_run_words", "n_ends")

_SPACE = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
_SYMBOL = np.array([chr(c) in "#*$%&|<>" for c in range(256)])
_LETTER = np.array([c >= 128 or chr(c).isalpha() for c in range(256)])
_PUNCTUATION = np.array([33 <= c < 127 and not chr(c).isalnum() for c in range(256)])
_END = np.array([chr(c) in ".!?" for c in range(256)])
_CUT = re.compile(rb"[\x20\x09-\x0D]")


@dataclass(frozen=True)
class Rule:
    """Votes good where ``good`` holds, bad where ``bad`` does: SQL over ``FIGURES``; null is false."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("length", "n_words between 50 and 100000", "n_words < 20"),
    Rule("word length", "word_chars between 2 * n_words and 12 * n_words", "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("symbols", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("duplicate lines", "n_lines > 1 and 20 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeated words", "20 * n_repeat_words <= n_words", "100 * n_repeat_words > 15 * n_words"),
    Rule("letters", "10 * n_letter_words >= 9 * n_words", "10 * n_letter_words < 7 * n_words"),
    Rule("capitals", "10 * n_upper <= word_chars", "2 * n_upper > word_chars"),
    Rule("runs of signs", "50 * n_run_words <= n_words", "10 * n_run_words > n_words"),
    Rule("vocabulary", "10 * n_distinct >= 3 * n_words", "n_words >= 20 and 20 * n_distinct < n_words or n_words between 20 and 1000 and 4 * n_distinct < n_words"),
    Rule("sentences", "100 * n_ends between n_words and 50 * n_words", "n_words >= 50 and (300 * n_ends < n_words or 5 * n_ends > 4 * n_words)"),
)


def _pieces(text: bytes):
    """The text in pieces of about ``PIECE`` bytes that end with a word."""
    at = 0
    while at < len(text):
        cut = _CUT.search(text, at + PIECE) if at + PIECE < len(text) else None
        end = cut.start() if cut else len(text)
        yield text[at:end] if at or end < len(text) else text
        at = end


def _ranks(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1]


def repeated_words(words: np.ndarray) -> int:
    """Words (as numbers) that lie in a window of ``WINDOW`` words found twice or more.

    Windows are told apart by a hash first; where two hashes agree all windows are numbered exactly, by pairs of pairs of pairs.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    drawn = np.random.default_rng(11).integers(0, 1 << 62, int(words.max()) + 1, dtype=np.uint64)
    print_ = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        print_ = print_ * np.uint64(0x9E3779B97F4A7C15) + drawn[words[k : n - WINDOW + 1 + k]]
    print_.sort()
    if not (print_[1:] == print_[:-1]).any():
        return 0
    number, step = words.astype(np.int64), 1
    while step < WINDOW:
        number = _ranks(number[:-step] * (int(number.max()) + 1) + number[step:])
        step *= 2
    starts = np.nonzero(np.bincount(number)[number] > 1)[0]
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def figures_of(text: bytes | None) -> tuple[int, ...]:
    """``FIGURES`` of a whole text, which is cut into words piece by piece; only the distinct words are held."""
    if not text:
        return (0,) * len(FIGURES)
    known: dict[bytes, int] = {}
    numbers, letters, runs, ends, chars, symbols, upper = [], 0, 0, 0, 0, 0, 0
    for piece in _pieces(text):
        words = piece.split()
        numbers.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        data = np.frombuffer(piece, np.uint8)
        space = _SPACE[data]
        symbols += int(np.count_nonzero(_SYMBOL[data]))
        upper += int(np.count_nonzero((data >= 65) & (data <= 90)))
        chars += int(np.count_nonzero(((data & 0xC0) != 0x80) & ~space))
        if words:
            starts = np.nonzero(~space & np.concatenate([[True], space[:-1]]))[0]
            last = np.nonzero(~space & np.concatenate([space[1:], [True]]))[0]
            letters += int(np.count_nonzero(np.logical_or.reduceat(_LETTER[data], starts)))
            double = np.concatenate([[False], (data[1:] == data[:-1]) & _PUNCTUATION[data[1:]]])
            runs += int(np.count_nonzero(np.logical_or.reduceat(double, starts)))
            ends += int(np.count_nonzero(_END[data[last]]))
    words = np.concatenate(numbers)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (len(words), chars, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words), len(known), letters, upper, runs, ends)


def with_figures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the struct ``figures`` of ``FIGURES``, of each whole text; a column of that name is replaced."""
    need_columns("quality_rules", "text_col", docs, [text_col])
    docs = docs.drop("figures")
    at = docs.columns.index(text_col)
    names = [*(f"c{i}" for i in range(len(docs.columns))), "figures"]

    def run(batches):
        for batch in batches:
            for part in slices(batch, at):
                found = np.array([figures_of(t) for t in texts_of(part.column(at))], np.int64).reshape(-1, len(FIGURES))
                made = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(FIGURES))], names=list(FIGURES))
                yield pa.RecordBatch.from_arrays([*part.columns, made], names=names)

    plain = docs.toDF(*names[:-1])
    kind = StructType([StructField(n, LongType()) for n in FIGURES])
    return plain.mapInArrow(run, schema_with(plain, StructField("figures", kind))).toDF(*docs.columns, "figures")


def _votes(rules: tuple[Rule, ...]) -> list[Column]:
    """-1, 0 or 1 for each rule, over the columns of ``FIGURES``."""
    return [F.expr(f"case when {r.good} then 1 when {r.bad} then -1 else 0 end") for r in rules]


def _pattern(rules: tuple[Rule, ...]) -> Column:
    """The votes as one number, a digit to base 3 for each rule."""
    return sum(((v + 1).cast("long") * 3**i for i, v in enumerate(_votes(rules))), F.lit(0).cast("long"))


@dataclass
class Model:
    """What the votes are worth: the part of good documents, and how often each rule that votes is right on good and on bad ones."""

    rules: tuple[Rule, ...]
    prior: float = 0.8
    on_good: np.ndarray = field(default_factory=lambda: np.zeros(0))
    on_bad: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def __post_init__(self):
        if not len(self.on_good):
            self.on_good, self.on_bad = np.full(len(self.rules), 0.9), np.full(len(self.rules), 0.6)

    def weights(self) -> tuple[float, np.ndarray, np.ndarray]:
        """Log odds of good: without votes, and added by a good and by a bad vote of each rule."""
        return float(np.log(self.prior / (1 - self.prior))), np.log(self.on_good / (1 - self.on_bad)), np.log((1 - self.on_good) / self.on_bad)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        start, good, bad = self.weights()
        return 1 / (1 + np.exp(-(start + (votes > 0) @ good + (votes < 0) @ bad)))

    def probability(self) -> Column:
        """The posterior over the columns of ``FIGURES``, rounded to 9 places."""
        start, good, bad = self.weights()
        odds = F.lit(start)
        for vote, g, b in zip(_votes(self.rules), good, bad, strict=True):
            odds = odds + F.when(vote == 1, F.lit(float(g))).when(vote == -1, F.lit(float(b))).otherwise(0.0)
        return F.round(1 / (1 + F.exp(-odds)), 9)


def estimate(votes: np.ndarray, counts: np.ndarray, rules: tuple[Rule, ...], rounds: int = 500) -> Model:
    """Expectation maximisation over patterns of votes (a row each) and how many documents have them.

    Each figure takes part with two documents' worth of its starting value, so a rule that never votes keeps it. A rule's
    errors on good and on bad documents stay under 0.9 in sum, and the part of good ones between 0.02 and 0.98.
    """
    model = Model(rules)
    first = model.on_good.copy(), model.on_bad.copy()
    total, good_votes, bad_votes = counts.sum(), (votes > 0).astype(float), (votes < 0).astype(float)
    for _ in range(rounds if total else 0):
        p = model.posterior(votes)
        yes, no = counts * p, counts * (1 - p)
        on_good = (yes @ good_votes + 2 * first[0]) / (yes @ (good_votes + bad_votes) + 2)
        on_bad = (no @ bad_votes + 2 * first[1]) / (no @ (good_votes + bad_votes) + 2)
        on_good = np.clip(on_good, 0.05, 0.9999)
        on_bad = np.clip(on_bad, 0.0, 0.9999)
        on_bad = np.maximum(on_bad, np.minimum(1.1 - on_good, 0.9999))
        prior = float(np.clip(yes.sum() / total, 0.02, 0.98))
        moved = max(abs(prior - model.prior), np.abs(on_good - model.on_good).max(), np.abs(on_bad - model.on_bad).max())
        model.prior, model.on_good, model.on_bad = prior, on_good, on_bad
        if moved < 1e-10:
            break
    return model


def fit(figures: DataFrame, rules: tuple[Rule, ...] = RULES) -> Model:
    """The model of all rows of ``figures`` (with the columns of ``FIGURES``) that do not fail ``BASE_FAILED``, which are decided already.

    One count by pattern of votes; at most 3 to the number of rules patterns reach the driver. Without rows the starting
    values stay.
    """
    if not 1 <= len(rules) <= MOST_RULES:
        raise OpError("quality_rules", "rules", f"{len(rules)} rules; 1 to {MOST_RULES} are possible")
    rows = figures.where(f"not ({BASE_FAILED})").groupBy(_pattern(rules).alias("pattern")).agg(F.count(F.lit(1)).alias("n")).collect()
    rows.sort()  # sums in one order
    patterns = np.array([r["pattern"] for r in rows], np.int64)
    votes = (patterns[:, None] // 3 ** np.arange(len(rules))) % 3 - 1
    return estimate(votes, np.array([r["n"] for r in rows], float), rules)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep: float = KEEP) -> DataFrame:
    """``(id, figures..., base_failed, probability, kept)``, a row for each row of ``docs``.

    base_failed: under 20 words, or over 30 % of them in repeated windows; such a row is not kept. Any other stays if its
    posterior probability is ``keep`` or more. Equal texts are judged alike; repeated rows repeat; nulls are empty texts.
    """
    need_columns("quality_rules", "id_col/text_col", docs, [id_col, text_col])
    found = with_figures(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    found = checkpoint(found.select("id", "figures.*"))
    model = fit(found, rules)
    out = found.withColumn("base_failed", F.expr(BASE_FAILED)).withColumn("probability", model.probability())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= keep))


def drop_low_quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, keep: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that stay, all columns as they are; texts are read twice, none is shuffled or stored."""
    need_columns("quality_rules", "text_col", docs, [text_col])
    names = docs.columns
    plain = docs.toDF(*[f"d{i}" for i in range(len(names))])
    text = f"d{names.index(text_col)}"
    model = fit(with_figures(plain.select(text), text).select("figures.*"), rules)
    rows = with_figures(plain, text).select(*plain.columns, "figures.*")
    return rows.where(~F.expr(BASE_FAILED) & (model.probability() >= keep)).select(*plain.columns).toDF(*names)
