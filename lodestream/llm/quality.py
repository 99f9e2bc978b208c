"""Operator 2: quality classifier from weak labels.

Overlapping heuristic labellers vote good, junk or nothing on every document. Expectation-maximisation over the counts of
all vote patterns of the corpus (at most 3 ** labellers rows, whatever the corpus) estimates each labeller's accuracy and
each pattern's posterior, without true labels. Junk comes in kinds, each of which shows in some labellers only; labellers are
independent given the kind, and kinds are added while they improve the Bayesian information criterion. The posteriors of a
bounded sample of documents then train a logistic scorer on hashed features of token shapes and words, which scores every
document.

Statistics cover all documents; only the scorer is fitted on a sample, of at most TRAIN_ROWS documents chosen by a hash of
their id and text, each with its TRAIN_FEATURES heaviest features at most. Labels of people are not used in fitting. Whole
texts are read: tokens over PIECE characters are cut into pieces that all count, and the share of distinct words is an average
over windows of WINDOW tokens, so that it means the same in texts of every length.

By rule a labeller abstains between its two bounds; on texts without tokens; on upper case in texts with fewer than 20
letters; and on shares of words in texts with fewer than 20 tokens, which say little.

Defined cases: null and empty texts get no votes and are scored by the scorer's constant; texts of any length are read whole;
ids may be null or repeat; ties (a score at the threshold) are kept; with no documents the result is empty; where the sample
holds one class only, the scorer still gives the prior; other columns are not read (scores) or pass through (drop_rejected).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, discard, forget_others, materialize, plain_names

#: Documents the scorer is fitted on, at most.
TRAIN_ROWS = 6_000
#: Features of a document that the scorer is fitted on, at most. Scores use all of them.
TRAIN_FEATURES = 4_096
BITS = 15
#: Characters of a token's pieces, and tokens of a window for the share of distinct words.
PIECE, WINDOW = 64, 1000
ABSTAIN, GOOD, JUNK = 0, 1, 2
#: (statistic, good below, junk above); between the two a labeller abstains. A negated statistic votes the other way.
LABELLERS = (
    ("symbols", 0.03, 0.08),
    ("upper", 0.15, 0.5),
    ("bare", 0.02, 0.15),
    ("marked", 0.05, 0.3),
    ("repeated", 0.05, 0.25),
    ("commonest", 0.12, 0.3),
    ("-distinct", -0.3, -0.12),
    ("-short", -0.12, -0.06),
)
#: Chance that a labeller flags a (good, junk) document, as PSEUDO_VOTES imagined votes of each class say; data outweigh them.
FLAGGED, PSEUDO_VOTES = (0.002, 0.3), 2.0
#: Share of good documents as PSEUDO_DOCUMENTS imagined ones say, for tables that are too small to tell.
GOOD_SHARE, PSEUDO_DOCUMENTS = 0.9, 20.0
_SYMBOLS = np.zeros(256, bool)
_LETTERS = bytes([*range(65, 91), *range(97, 123)])
_KINDS = bytes(88 if 65 <= b <= 90 else 120 if 97 <= b <= 122 else 57 if 48 <= b <= 57 else b for b in range(256))
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)
_SYMBOLS[[ord(c) for c in "!#$%&*+/<=>@\\^_`{|}~[]"]] = True


def _case_shape(word: str) -> str | None:
    """Shape of a word of letters in one of the usual cases."""
    if word.islower():
        return "x" if len(word) == 1 else "x+"
    if word.isupper():
        return "X" if len(word) == 1 else "X+"
    if word[0].isupper() and word[1:].islower():
        return "Xx" if len(word) == 2 else "Xx+"
    return None


def token_shape(token: str) -> str:
    """Kinds of a token's characters (X and x for letters, 9 for digits, others as they are), runs as `kind+`."""
    if token.isascii():
        return _RUNS.sub(rb"\1+", token.encode().translate(_KINDS)).decode()
    word, rest = (token, "") if token.isalpha() else (token[:-1], token[-1])
    if word.isalpha() and (shape := _case_shape(word)):
        return shape + ("9" if rest.isdigit() else rest)
    last, shape = "", []
    for c in token:
        kind = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if kind != last:
            shape.append(kind)
        elif shape[-1] != "+":
            shape.append("+")
        last = kind
    return "".join(shape)


def tokens_of(text: str) -> list[str]:
    """Tokens between white space, those over PIECE characters in pieces."""
    tokens = text.split()
    if len(text) > PIECE and max(map(len, tokens), default=0) > PIECE:
        return [t[i : i + PIECE] for t in tokens for i in range(0, len(t), PIECE)]
    return tokens


class _Tokens(dict):
    """Row of a token in a table of word hashes, shape hashes and flags; the memory is emptied when full."""

    ROOM = 300_000

    def __init__(self):
        self.reset()

    def reset(self) -> None:
        """Forget all tokens; room for them is made with the next one."""
        self.clear()
        self.words = self.shapes = self.info = np.empty(0, np.int64)
        self.of_shape: dict[str, int] = {}

    def __missing__(self, token: str) -> int:
        at = self[token] = len(self)
        if token.isalpha():
            letters, shape, word, flags = len(token), (token.isascii() and _case_shape(token)) or token_shape(token), token.lower(), 0
        else:
            letters = len(token) - len(token.encode().translate(None, _LETTERS)) if token.isascii() else sum(map(str.isalpha, token))
            shape, word = token_shape(token), token.strip(".,;:'\"()-!?").lower()
            bare = not letters and not any(map(str.isalnum, token))
            marked = len(token) - len(token.rstrip("!#$%&*?@~^")) >= 2
            flags = 256 * bare | 512 * marked
        code = self.of_shape.get(shape)
        if code is None:
            if len(self.of_shape) >= self.ROOM:
                self.of_shape.clear()
            code = self.of_shape[shape] = xxhash.xxh3_64_intdigest(shape) & 0xFFFFFFFF
        self.words[at] = xxhash.xxh3_64_intdigest(word) >> 1
        self.shapes[at] = code
        self.info[at] = letters | flags
        return at

    def rows(self, tokens: list[str]) -> np.ndarray:
        if len(self) + len(tokens) > len(self.words):
            self.reset()
            room = max(self.ROOM, 2 * len(tokens))  # a very long text has room for all its tokens
            self.words, self.shapes, self.info = (np.empty(room, np.int64) for _ in range(3))
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


_tokens = _Tokens()


def _forget() -> None:
    _tokens.reset()


_MIX = np.uint64(0x9E3779B97F4A7C15)


def analyse(text: str, features: bool) -> tuple[dict[str, float], np.ndarray, np.ndarray]:
    """Statistics for the labellers, and hashed features with weights of unit length."""
    raw = np.frombuffer(text.encode(), np.uint8)
    counts = np.bincount(raw, minlength=256) if len(raw) else np.zeros(256, np.int64)
    tokens = tokens_of(text)
    n = len(tokens)
    if not n:
        return {}, np.array([0], np.int64), np.array([1.0])
    rows = _tokens.rows(tokens)
    words, shapes, info = _tokens.words[rows], _tokens.shapes[rows], _tokens.info[rows]
    ordered = np.sort(words)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    distinct, often = ordered[first], np.diff(np.append(first, n))
    repeats = float(np.count_nonzero(words[1:] == words[:-1]) / n)
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[192:].sum()
    lengths = info & 255
    stats = {
        "symbols": float(counts[_SYMBOLS].sum() / max(1, len(raw))),
        "bare": float(np.count_nonzero(info & 256) / n),
        "marked": float(np.count_nonzero(info & 512) / n),
        "repeated": repeats,
    }
    if letters >= 20:
        stats["upper"] = float(counts[65:91].sum() / letters)
    if n >= 20:  # shares of fewer words say little
        stats["commonest"] = float(often.max() / n)
        different = len(distinct)
        if n > WINDOW:  # distinct words of each window
            placed = np.sort(words ^ (np.arange(n) // WINDOW * np.int64(0x2545F4914F6CDD1D)))
            different = 1 + np.count_nonzero(placed[1:] != placed[:-1])
        stats["-distinct"] = -float(different / n)
        stats["-short"] = -float(np.count_nonzero((lengths > 0) & (lengths <= 3)) / n)
    if not features:
        return stats, np.empty(0, np.int64), np.empty(0)
    shape_codes = shapes.astype(np.uint64) * _MIX
    pair_codes = (shape_codes[:-1] ^ (shape_codes[1:] >> np.uint64(7))) * _MIX
    word_codes = distinct.astype(np.uint64) * _MIX
    groups = []
    for salt, (codes, weights, norm) in enumerate(((shape_codes, None, n), (pair_codes, None, max(1, n - 1)), (word_codes, often, 2.0 * n))):
        at = ((codes ^ np.uint64(salt * 0x5851F42D4C957F2D & 0xFFFFFFFFFFFFFFFF)) * _MIX >> np.uint64(64 - BITS)).astype(np.int64)
        order = np.argsort(at)
        at = at[order]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(at) else np.empty(0, np.int64)
        sums = np.diff(np.append(first, len(at))) if weights is None else np.add.reduceat(weights[order], first)
        groups.append((at[first], np.sqrt(sums / norm)))
    named = [(hash_name(f"{k}:{min(20, int(abs(v) * 20))}"), 0.5) for k, v in stats.items()]
    keys = np.concatenate([g[0] for g in groups] + [np.array([k for k, _ in named], np.int64), np.array([0], np.int64)])
    values = np.concatenate([g[1] for g in groups] + [np.array([v for _, v in named]), np.array([1.0])])
    return stats, keys, values


def hash_name(name: str) -> int:
    return xxhash.xxh3_64_intdigest(name) >> (64 - BITS)


def vote_pattern(stats: dict[str, float]) -> int:
    """The votes as one number in base 3."""
    pattern = 0
    for name, low, high in reversed(LABELLERS):
        v = stats.get(name)
        pattern = pattern * 3 + (ABSTAIN if v is None else GOOD if v < low else JUNK if v > high else ABSTAIN)
    return pattern


def _maximise(votes: np.ndarray, weight: np.ndarray, rates: np.ndarray, shares: np.ndarray, rounds: int = 300) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log likelihood, chance of each class for each pattern, flag rates, class shares) by expectation-maximisation from the
    given rates (class by labeller; class 0 is good text) and shares."""
    flag, passed, cast = ((votes == JUNK).astype(float), (votes == GOOD).astype(float), (votes != ABSTAIN).astype(float))
    imagined = PSEUDO_VOTES * np.array([FLAGGED[0], *[FLAGGED[1]] * (len(rates) - 1)])[:, None]
    last = -np.inf
    for _ in range(rounds):
        chance = np.log(shares) + flag @ np.log(rates).T + passed @ np.log(1 - rates).T  # a labeller that abstains says nothing
        top = chance.max(1, keepdims=True)
        chance = np.exp(chance - top)
        total = chance.sum(1, keepdims=True)
        chance /= total
        fit = float(weight @ (top + np.log(total))[:, 0])
        counted = chance * weight[:, None]
        imagined_shares = np.array([GOOD_SHARE, *[(1 - GOOD_SHARE) / (len(shares) - 1)] * (len(shares) - 1)])
        shares = (counted.sum(0) + PSEUDO_DOCUMENTS * imagined_shares) / (weight.sum() + PSEUDO_DOCUMENTS)
        rates = np.clip((counted.T @ flag + imagined) / (counted.T @ cast + PSEUDO_VOTES), 1e-6, 1 - 1e-6)
        if abs(fit - last) <= 1e-9 * abs(fit):
            break
        last = fit
    return fit, chance, rates, shares


def estimate(patterns: dict[int, int]) -> tuple[dict[int, float], np.ndarray]:
    """Posterior chance of good for each vote pattern, and each labeller's estimated chance to flag (junk, good) when it votes.

    Starts from one kind of junk. A further kind is tried from each labeller, as if that one flagged it, and stays if the best
    of them lowers the Bayesian information criterion."""
    codes = np.array(sorted(patterns), np.int64)
    weight = np.array([patterns[c] for c in codes.tolist()], float)
    votes = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    n = len(LABELLERS)
    # one more class has n rates and a share
    criterion = lambda found: (n + 1) * len(found[3]) * np.log(max(2.0, weight.sum())) - 2 * found[0]
    best = _maximise(votes, weight, np.array([[FLAGGED[0]] * n, [0.6] * n]), np.array([0.9, 0.1]))
    while len(best[3]) <= n:
        kinds = np.full((n, n), 0.1) + 0.8 * np.eye(n)
        tried = min((_maximise(votes, weight, np.vstack([best[2], kind]), np.append(best[3] * 0.98, 0.02)) for kind in kinds), key=criterion)
        if criterion(tried) >= criterion(best):
            break
        best = tried
    _, chance, rates, _ = best
    good = chance[:, int(rates.mean(1).argmin())]  # the class that labellers flag least
    measured = [((weight * p) @ (votes == JUNK) + PSEUDO_VOTES * prior) / ((weight * p) @ (votes != ABSTAIN) + PSEUDO_VOTES) for p, prior in ((1 - good, FLAGGED[1]), (good, FLAGGED[0]))]
    return dict(zip(codes.tolist(), good.tolist(), strict=True)), np.array(measured)


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 150, decay: float = 1e-5) -> np.ndarray:
    """Weights of a logistic scorer for soft targets, by accelerated gradient descent."""
    weights = np.zeros(1 << BITS)
    if not rows:
        return weights
    keys, values = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    starts = np.cumsum([0, *(len(r[0]) for r in rows)])[:-1]
    of = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    target = np.array([r[2] for r in rows])
    # both classes weigh the same in all
    share = np.where(target >= 0.5, 0.5 / max(1, (target >= 0.5).sum()), 0.5 / max(1, (target < 0.5).sum()))
    step, last = 1.5, weights
    for t in range(rounds):
        ahead = weights + t / (t + 3) * (weights - last)
        score = 1 / (1 + np.exp(-np.clip(np.add.reduceat(ahead[keys] * values, starts), -40, 40)))
        gradient = np.bincount(keys, ((score - target) * share)[of] * values, 1 << BITS) + decay * ahead
        last, weights = weights, ahead - step * gradient
    return weights


def score(weights: np.ndarray, keys: np.ndarray, values: np.ndarray) -> float:
    return float(1 / (1 + np.exp(-np.clip(weights[keys] @ values, -40, 40))))


@dataclass(frozen=True)
class Model:
    """Posteriors by vote pattern, the scorer's weights, and each labeller's estimated chance to flag (junk, good)."""

    posteriors: dict[int, float]
    weights: np.ndarray
    rates: np.ndarray | None


def fit(df: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model of df: votes over all of it, the scorer on a sample."""
    bounded_batches(df.sparkSession)
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def vote(batches):
        forget_others("quality", _forget)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([vote_pattern(analyse(t or "", False)[0]) for t in b.column(1).to_pylist()], pa.int32())], names=["doc_id", "pattern"])

    votes = materialize(source.mapInArrow(vote, "doc_id long, pattern int"), "votes")
    counted = {r["pattern"]: r["n"] for r in votes.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most 3 ** labellers rows
    discard(votes)
    posteriors, rates = estimate(counted) if counted else ({}, None)

    def features(batches):
        forget_others("quality", _forget)
        for b in batches:
            made = []
            for t in b.column(1).to_pylist():
                stats, keys, values = analyse(t or "", True)
                if len(keys) > TRAIN_FEATURES:
                    heaviest = np.sort(np.argsort(-values, kind="stable")[:TRAIN_FEATURES])
                    keys, values = keys[heaviest], values[heaviest]
                made.append((vote_pattern(stats), keys, values))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m[0] for m in made], pa.int32()), pa.array([m[1].astype(np.int32).tobytes() for m in made], pa.binary()), pa.array([m[2].astype(np.float32).tobytes() for m in made], pa.binary())], names=["doc_id", "pattern", "keys", "weights"])

    # Rows below a bound on their hash: the same whatever the partitions. Four deviations below train_rows, so that the limit,
    # which would choose by partition, is a guarantee that doesn't bite.
    total = sum(counted.values())
    share = 1.0 if total <= train_rows else max(0.0, train_rows - 4 * train_rows**0.5) / total
    sample = source.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < int(share * (1 << 40))).limit(train_rows)
    rows = sample.mapInArrow(features, "doc_id long, pattern int, keys binary, weights binary").collect()
    rows.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["keys"]))
    weights = fit_scorer([(np.frombuffer(r["keys"], np.int32), np.frombuffer(r["weights"], np.float32), posteriors.get(r["pattern"], 0.5)) for r in rows])
    return Model(posteriors, weights, rates)


def score_documents(df: DataFrame, threshold: float = 0.5, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """One row for each row of df: doc_id, posterior (of its votes), score (of the scorer), keep (score >= threshold). By the
    given model, or else by that of df itself."""
    model = model or fit(df, train_rows, id_col, text_col)
    bounded_batches(df.sparkSession)

    def run(batches):
        forget_others("quality", _forget)
        for b in batches:
            made = [analyse(t or "", True) for t in b.column(1).to_pylist()]
            scores = [score(model.weights, k, v) for _, k, v in made]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.posteriors.get(vote_pattern(m[0]), 0.5) for m in made], pa.float64()), pa.array(scores, pa.float64()), pa.array([x >= threshold for x in scores], pa.bool_())], names=["doc_id", "posterior", "score", "keep"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(run, "doc_id long, posterior double, score double, keep boolean")


def drop_rejected(df: DataFrame, threshold: float = 0.5, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that the scorer keeps, in one pass without a shuffle."""
    rows, name = plain_names(df)
    at = name(text_col)
    weights = fit(rows, train_rows, name(id_col), at).weights

    def run(batches):
        forget_others("quality", _forget)
        for b in batches:
            yield b.filter(pa.array([score(weights, *analyse(t or "", True)[1:]) >= threshold for t in b.column(at).to_pylist()], pa.bool_()))

    return rows.mapInArrow(run, rows.schema).toDF(*df.columns)
