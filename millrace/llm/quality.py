"""Quality by weak supervision.

Each rule looks at one trait of a text and votes good (1), bad (-1) or abstains (0). No rule decides alone:
expectation-maximisation over the vote patterns of all documents estimates how often each rule votes good and bad
on good and on bad texts, and the posterior probability of being good replaces all-must-pass filtering.

The texts are read once. The estimation runs on the counts of vote patterns, at most 3 ** 8 whatever the corpus.
Defined cases: a null text has no words; a text without words fails the base rules; repeated rows count as often as
they are listed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.storage import stored

from .batches import per_text

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
CONTINUATION = bytes(range(128, 192))
ASCII_OTHER = bytes(x for x in range(128) if x not in UPPER + LOWER)
WINDOW = 8

FIELDS = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, "
          "n_distinct long, n_letters long, n_upper long, n_lower long, n_shouts long")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more, first occurrences included.

    A hash of each window finds texts without repeats quickly; repeats are then compared as windows.
    """
    n = len(words) - window + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.uint64)
    with np.errstate(over="ignore"):
        h = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        total = np.zeros(n, np.uint64)
        for k in range(window):
            total = total * np.uint64(0x100000001B3) + h[k:k + n]
    order = np.argsort(total, kind="stable")
    same = total[order][1:] == total[order][:-1]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    seen: dict[bytes, list[int]] = {}
    for i in np.flatnonzero(maybe).tolist():
        seen.setdefault(ids[i:i + window].tobytes(), []).append(i)
    ends = np.zeros(len(words) + 1, np.int64)
    for starts in seen.values():
        if len(starts) > 1:
            np.add.at(ends, starts, 1)
            np.add.at(ends, np.array(starts) + window, -1)
    return int((np.cumsum(ends) > 0).sum())


def measures(text: bytes) -> tuple[int, ...]:
    """The numbers of FIELDS for one text."""
    words = text.split()  # of bytes: splits at exactly \x20 and \x09-\x0D
    lines = [x for x in text.split(b"\n") if x.strip()]
    count = lambda drop: len(text) - len(text.translate(None, drop))
    upper, lower = count(UPPER), count(LOWER)
    return (len(words), len(text.translate(None, WHITE + CONTINUATION)), count(SYMBOLS), len(lines) - len(set(lines)),
            repeated_words(words), len(lines), len(set(words)), upper + lower + len(text.translate(None, ASCII_OTHER + UPPER + LOWER + CONTINUATION)),
            upper, lower, text.count(b"!"))


def text_measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return per_text(docs, lambda: measures, FIELDS, id_col, text_col)


def _vote(share: Column, bad: Column, good: Column) -> Column:
    return F.when(share.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def _high_is_bad(top: str, bottom: str, good: float, bad: float) -> Column:
    share = F.try_divide(F.col(top), F.col(bottom))
    return _vote(share, share > bad, share <= good)


def _low_is_bad(top: str, bottom: str, bad: float, good: float) -> Column:
    share = F.try_divide(F.col(top), F.col(bottom))
    return _vote(share, share < bad, share >= good)


def default_rules() -> dict[str, Column]:
    length = F.try_divide(F.col("word_chars"), F.col("n_words"))
    return {
        "symbols": _high_is_bad("n_symbols", "n_words", 0.02, 0.2),
        "letters": _low_is_bad("n_letters", "word_chars", 0.55, 0.8),
        "capitals": F.when(F.col("n_upper") + F.col("n_lower") < 20, F.lit(0).cast("tinyint")).otherwise(
            _vote(F.lit(1.0), F.col("n_upper") > F.col("n_lower"), F.col("n_upper") * 6 <= F.col("n_lower"))),
        "shouts": _high_is_bad("n_shouts", "n_words", 0.05, 0.5),
        "repeats": _high_is_bad("n_repeat_words", "n_words", 0.15, 0.3),
        "same_lines": _high_is_bad("n_dup_lines", "n_lines", 0.15, 0.5),
        "variety": F.when(F.col("n_words") < 50, F.lit(0).cast("tinyint")).otherwise(_low_is_bad("n_distinct", "n_words", 0.08, 0.15)),
        "word_length": _vote(length, (length < 2.5) | (length > 15), (length >= 3) & (length <= 10)),
    }


#: A rule calls a good text bad at most this often. Without the bound, the two classes may settle on one kind of bad
#: text against all others; with it, any kind of bad text is unlikely among good ones.
SLIP = 0.002


def fit_votes(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, close: float = 1e-9,
              slip: float = SLIP) -> tuple[float, np.ndarray, np.ndarray]:
    """Expectation-maximisation for two classes with independent rules, each bound to be right on good texts.

    Returns the share of good texts, the chance of a bad and a good vote by class and rule (of a rule that votes; an
    abstention says nothing), and the posterior by pattern. ``patterns`` is (n, rules) of -1, 0, 1. The start says
    that rules are right more often than not, which names the classes.
    """
    votes = np.stack([patterns == v for v in (-1, 1)], 2).astype(float)  # n, rules, vote
    chance = np.empty((2, patterns.shape[1], 2))
    chance[0], chance[1] = [0.4, 0.6], [slip, 1 - slip]  # bad texts, good texts
    share, last = 0.8, -np.inf
    prior = np.array([[1.0, 1.0], [0.01, 2.0]])  # pseudo-counts, so that no chance is 0
    after = np.full(len(counts), share)
    for _ in range(rounds):
        logs = np.log(np.array([1 - share, share]))[:, None] + np.einsum("nrv,crv->cn", votes, np.log(chance))
        top = logs.max(0)
        weight = np.exp(logs - top)
        after = weight[1] / weight.sum(0)
        likelihood = float(((np.log(weight.sum(0)) + top) * counts).sum())
        if abs(likelihood - last) <= close * max(1.0, abs(likelihood)):
            break
        last = likelihood
        for c, w in enumerate((counts * (1 - after), counts * after)):
            raw = np.einsum("n,nrv->rv", w, votes) + prior[c]
            chance[c] = raw / raw.sum(1, keepdims=True)
        chance[1, :, 0] = np.minimum(chance[1, :, 0], slip)
        chance[1, :, 1] = 1 - chance[1, :, 0]
        share = float((counts * after).sum() + 8) / (counts.sum() + 10)
    return share, chance, after


def label(rows: DataFrame, rules: Mapping[str, Column], fit: Callable = fit_votes) -> DataFrame:
    """``rows`` with ``votes`` (one per rule) and ``posterior``, the probability of being good.

    At most eight rules, so that the pattern table (3 ** rules rows) may go to the driver and be broadcast.
    """
    if not 0 < len(rules) <= 8:
        raise ValueError("one to eight rules")
    voted = rows.withColumn("votes", F.array(*rules.values()))
    found = sorted((tuple(r.votes), r.n) for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect())
    if not found:
        return voted.withColumn("posterior", F.lit(None).cast("double"))
    _, _, after = fit(np.array([p for p, _ in found]), np.array([n for _, n in found], float))
    table = rows.sparkSession.createDataFrame([(list(p), float(a)) for (p, _), a in zip(found, after)], "votes array<tinyint>, posterior double")
    return voted.join(F.broadcast(table), "votes")


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per document: id, the measures, votes, posterior, base_failed and kept."""
    rows = stored(text_measures(docs, id_col, text_col), "measures")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return label(rows, default_rules()).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= least))
