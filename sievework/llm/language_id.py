"""Language identification of whole, possibly mixed texts.

Each learned language has a table of letter-trigram log probabilities and the scripts that its training
text uses. The scripts of a word's letters narrow the candidates; the word then scores the sum of its
trigram log probabilities in each. A Viterbi pass over the words of a text, with one penalty for every
change of language, labels spans; the document's language is the one that labels most letters, and the
score is its share of the letters.

Learning takes a bounded sample of labelled rows (``max_rows``, the documented limit of this classifier),
chosen by id hash; counts are summed on the executors and at most languages x 2**bits counts reach the
driver. Prediction covers every word of every text.

Words end at white space; runs of scripts that are written without spaces are cut into pieces of PIECE
characters, and where such a run begins or ends, so that a text of one long run still holds several spans.

Row rules: null text and text without a letter get ``und`` with score 0 and no spans, as does every text
when nothing was learned. Texts may have any length. Ties between languages go to the smaller name. Repeated
rows are labelled one by one; empty tables give empty results. Extra columns pass through; those that have
the names of the outputs are replaced, as by withColumn.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, others, small_batches
from .words import slices, tidy

BITS = 16
MAX_ROWS = 8000
SWITCH_PENALTY = 12.0
UNKNOWN = "und"
CHUNK = 128
CACHED_WORDS = 100_000
#: A language keeps a script that holds this share of its training letters.
SCRIPT_SHARE = 0.01

#: First and last code points of the letters of scripts (Unicode blocks).
SCRIPT_RANGES = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF)],
    "ethiopic": [(0x1200, 0x139F)],
    "khmer": [(0x1780, 0x17FF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
SCRIPTS = [*SCRIPT_RANGES, "other"]
#: Scripts written without spaces, and the length of the pieces that stand for their words.
UNSPACED = "".join(f"{chr(a)}-{chr(b)}" for name in ("thai", "khmer", "kana", "han") for a, b in SCRIPT_RANGES[name])
PIECE = 4
_UNSPACED = re.compile(f"[{UNSPACED}]")
_WORD = re.compile(rf"[{UNSPACED}]{{1,{PIECE}}}|[^\s{UNSPACED}]+")


def pieces(text: str) -> list[str]:
    """The words of a text, as spans count them."""
    return _WORD.findall(text) if _UNSPACED.search(text) else text.split()


@functools.cache
def char_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: is it a letter, is it white space, its script."""
    n = 0x110000
    letter = np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)
    space = np.fromiter((chr(i).isspace() for i in range(n)), bool, n)
    script = np.full(n, len(SCRIPTS) - 1, np.int8)
    for k, ranges in enumerate(SCRIPT_RANGES.values()):
        for a, b in ranges:
            script[a : b + 1] = k
    return letter, space, script


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def trigrams(words: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, bucket) of every letter trigram of the lower-cased words, (owner, script) of every letter.

    A word's non-letters and both its ends count as one boundary character.
    """
    letter, _, script = char_tables()
    joined = "\n" + "\n".join(w.lower() for w in words) + "\n"
    cp = code_points(joined)
    owner = np.cumsum(cp == 10) - 1
    is_letter = letter[cp]
    cp = np.where(is_letter, cp, 0).astype(np.uint64)
    # one boundary between letters at most: drop a boundary that follows a boundary
    use = is_letter | np.concatenate(([True], is_letter[:-1]))
    cp, who = cp[use], owner[use]
    a, b, c = cp[:-2], cp[1:-1], cp[2:]
    # the middle is a letter, so that a window never spans two words' letters
    ok = b > 0
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F)) ^ (c * np.uint64(0x165667B19E3779F9))
    h = (h * np.uint64(0xFF51AFD7ED558CCD)) >> np.uint64(64 - bits)
    return who[1:-1][ok], h[ok].astype(np.int64), owner[is_letter], script[np.where(is_letter, code_points(joined), 0)][is_letter]


def count_sample(docs: DataFrame, text: str, lang: str, bits: int) -> DataFrame:
    """(lang, kind, bucket, n): trigram and script counts of the given rows, summed over partitions."""
    df = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in slices(batches, 1):
            for l, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = pieces(t)
                if not w:
                    continue
                _, grams, _, scripts = trigrams(w, bits)
                own = total.setdefault(l, np.zeros((1 << bits) + len(SCRIPTS), np.int64))
                own += np.bincount(np.concatenate((grams, scripts.astype(np.int64) + (1 << bits))), minlength=len(own))
        for l, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([l] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(own[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    return df.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    bits: int = BITS,
    max_rows: int = MAX_ROWS,
) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, log probability [bucket, language], allowed [script, language]) from labelled rows."""
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col(lang).isNotNull())
    n = labelled.count()
    if n > max_rows:
        labelled = labelled.where(F.pmod(F.xxhash64(doc_id), F.lit(1_000_003)) < int(1_000_003 * max_rows / n))
    got = count_sample(labelled, text, lang, bits).toPandas()
    langs = sorted(got["lang"].unique().tolist())
    counts = np.zeros(((1 << bits) + len(SCRIPTS), len(langs)))
    place = {l: k for k, l in enumerate(langs)}
    counts[got["bucket"].to_numpy(np.int64), got["lang"].map(place).to_numpy(np.int64)] = got["n"].to_numpy(float)
    grams, scripts = counts[: 1 << bits], counts[1 << bits :]
    seen = max(1, int((grams.sum(1) > 0).sum()))
    logp = np.log((grams + 0.5) / (grams.sum(0) + 0.5 * seen))
    allowed = scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(0))
    return langs, logp.astype(np.float32), allowed


class Labeller:
    def __init__(self, langs: list[str], logp: np.ndarray, allowed: np.ndarray, penalty: float, bits: int):
        self.langs, self.logp, self.allowed, self.penalty, self.bits = langs, logp, allowed, penalty, bits
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.scores = np.zeros((1 << 12, len(self.langs)), np.float32)
        self.letters = np.zeros(1 << 12, np.int64)

    def learn(self, words: list[str]) -> None:
        owner, gram, letter_owner, script = trigrams(words, self.bits)
        n = len(words)
        s = np.stack([np.bincount(owner, self.logp[gram, k], n) for k in range(len(self.langs))], 1)
        letters = np.bincount(letter_owner, minlength=n)
        # script ranges narrow the candidates; a script that no language has narrows nothing
        bad = np.stack([np.bincount(letter_owner, ~self.allowed[script, k], n) for k in range(len(self.langs))], 1)
        bad[bad.min(1) > 0] = 0
        s -= 50.0 * bad
        s[letters == 0] = 0
        k = len(self.index)
        while k + n > len(self.letters):
            self.scores = np.concatenate((self.scores, np.zeros_like(self.scores)))
            self.letters = np.concatenate((self.letters, np.zeros_like(self.letters)))
        self.scores[k : k + n], self.letters[k : k + n] = s, letters
        self.index.update(zip(words, range(k, k + n)))

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, score, spans) of each text; a span is (first, end) in words and a language."""
        if len(self.index) > CACHED_WORDS:
            self.reset()
        split = [pieces(t) for t in texts]
        new = set().union(*split).difference(self.index)
        if new:
            self.learn(list(new))
        n = np.array([len(w) for w in split], np.int64)
        at = np.fromiter((k for w in split for k in map(self.index.__getitem__, w)), np.int64, int(n.sum()))
        labels = viterbi(self.scores[at].astype(np.float64), n, self.penalty)
        letters = self.letters[at]
        ends = np.cumsum(n)
        owner = np.repeat(np.arange(len(n)), n)
        share = np.bincount(owner * len(self.langs) + labels, letters, len(n) * len(self.langs)).reshape(len(n), -1)
        total = share.sum(1)
        best = share.argmax(1)
        change = np.flatnonzero((np.diff(labels) != 0) | (np.diff(owner) != 0)) + 1
        out = []
        for i, (a, b) in enumerate(zip((ends - n).tolist(), ends.tolist())):
            if not total[i]:
                out.append((UNKNOWN, 0.0, []))
                continue
            cuts = [a, *change[np.searchsorted(change, a, "right") : np.searchsorted(change, b)].tolist(), b]
            spans = [(x - a, y - a, self.langs[labels[x]]) for x, y in zip(cuts, cuts[1:])]
            out.append((self.langs[best[i]], float(share[i, best[i]] / total[i]), spans))
        return out


def viterbi(scores: np.ndarray, n: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word of many texts (n words each): word scores less a penalty for each change.

    Texts are cut into chunks that advance side by side, so the number of steps is CHUNK plus the most
    chunks of a text: first each chunk's best score for every pair of incoming and last label, then the
    chunks' borders in text order, then the labels inside all chunks with their borders known.
    """
    langs = scores.shape[1]
    if langs == 1 or not len(scores):
        return np.zeros(len(scores), np.int64)
    parts = np.maximum(1, -(-n // CHUNK)) * (n > 0)
    text_of = np.repeat(np.arange(len(n)), parts)
    k = np.arange(len(text_of)) - np.repeat(np.cumsum(parts) - parts, parts)
    start = (np.cumsum(n) - n)[text_of] + k * CHUNK
    size = np.minimum(CHUNK, n[text_of] - k * CHUNK)
    order = np.argsort(-size, kind="stable")
    start, size, k, text_of = start[order], size[order], k[order], text_of[order]
    alive = np.searchsorted(-size, -np.arange(CHUNK), "left")  # chunks with more than t words
    move = np.where(np.eye(langs, dtype=bool), 0.0, -penalty)

    several = np.flatnonzero(parts[text_of] > 1)
    incoming = np.full(len(start), -1)
    outgoing = np.full(len(start), -1)
    if len(several):
        s0, n0 = start[several], size[several]
        live = np.searchsorted(-n0, -np.arange(CHUNK), "left")
        # the first chunk of a text has no label before it
        v = scores[s0][:, None, :] + np.where((k[several] == 0)[:, None, None], 0.0, move)
        for t in range(1, CHUNK):
            m = live[t]
            if not m:
                break
            w = v[:m]
            v[:m] = np.maximum(w, w.max(2, keepdims=True) - penalty) + scores[s0[:m] + t][:, None, :]
        rank = np.full(len(start), -1)
        rank[several] = np.arange(len(several))
        by_place = [np.flatnonzero((k == j) & (rank >= 0)) for j in range(int(k.max()) + 1)]
        best = np.zeros((len(n), langs))
        back = []
        for j, rows in enumerate(by_place):
            own = v[rank[rows]]
            if j == 0:
                best[text_of[rows]] = own[:, 0]
                back.append(None)
            else:
                total = best[text_of[rows]][:, :, None] + own
                back.append(total.argmax(1))
                best[text_of[rows]] = total.max(1)
        label = best.argmax(1)
        for j in range(len(by_place) - 1, -1, -1):
            rows = by_place[j]
            outgoing[rows] = label[text_of[rows]]
            if j:
                before = back[j][np.arange(len(rows)), outgoing[rows]]
                incoming[rows] = before
                label[text_of[rows]] = before

    first = np.where(incoming >= 0, incoming, 0)
    v = scores[start] + np.where((incoming >= 0)[:, None], move[first], 0.0)
    back = np.zeros((len(scores), langs), np.int16)
    for t in range(1, CHUNK):
        m = alive[t]
        if not m:
            break
        w = v[:m]
        jump = w.max(1, keepdims=True) - penalty
        stay = w >= jump
        back[start[:m] + t] = np.where(stay, np.arange(langs), w.argmax(1)[:, None])
        v[:m] = np.where(stay, w, jump) + scores[start[:m] + t]
    now = np.where(outgoing >= 0, outgoing, v.argmax(1))
    labels = np.zeros(len(scores), np.int64)
    for t in range(CHUNK - 1, -1, -1):
        m = alive[t]
        if m:
            at = start[:m] + t
            labels[at] = now[:m]
            now[:m] = back[at, now[:m]] if t else now[:m]
    return labels


SPANS = T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType())])
)


def word_bounds(text: str) -> np.ndarray:
    """(start, end) in code points of every word."""
    if _UNSPACED.search(text):
        return np.array([m.span() for m in _WORD.finditer(text)], np.int64).reshape(-1, 2)
    space = char_tables()[1][code_points(text)]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
    return edge.reshape(-1, 2)


def predict(
    docs: DataFrame,
    model: tuple[list[str], np.ndarray, np.ndarray],
    text: str = "text",
    keep: list[str] | None = None,
    penalty: float = SWITCH_PENALTY,
    bits: int = BITS,
) -> DataFrame:
    """docs (or its columns ``keep``) plus lang_pred, score and spans (code points of the text, language)."""
    small_batches(docs.sparkSession)
    keep = others(docs.columns if keep is None else keep, "lang_pred", "score", "spans")
    own = free_name(docs, "__sw_text")
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias(own))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("spans", SPANS)]
    schema = T.StructType([*df.schema.fields[:-1], *added])

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(SPANS)
        langs, logp, allowed = shared.value
        labeller = Labeller(langs, logp, allowed, penalty, bits) if langs else None
        for part in slices(batches, len(keep)):
            texts = [t or "" for t in part.column(len(keep)).to_pylist()]
            got = labeller.label(texts) if labeller else [(UNKNOWN, 0.0, [])] * len(texts)
            spans = []
            for t, (_, _, found) in zip(texts, got):
                at = word_bounds(t) if len(found) > 1 else None
                if at is None:
                    spans.append([{"start": 0, "end": len(t), "lang": found[0][2]}] if found else [])
                else:
                    spans.append([{"start": int(at[a, 0]), "end": int(at[b - 1, 1]), "lang": l} for a, b, l in found])
            labels = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *labels], names=[*keep, "lang_pred", "score", "spans"])

    return df.mapInArrow(run, schema)


def digest(docs: DataFrame) -> DataFrame:
    """Contract rows: doc_id, held_out, lang_pred, score; rows of fold 0 of 5 are never learned from."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    docs = docs.select("doc_id", "text", "lang")
    model = fit(docs.where(fold != 0))
    found = predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))
