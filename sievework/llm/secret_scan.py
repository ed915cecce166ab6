"""Secret scans whose false positives a random forest removes.

Candidates are quoted values of assignments, unquoted values after a credential's name, and long mixed
tokens wherever they stand, inside quoted values too. Each is described by its length, its
character classes and the transitions between them, the log probability of its letter pairs, the share of
it that dictionary words cover, and the words beside it and the parts of its path, hashed into buckets; a
random forest trained from labelled findings gives the probability that it is a secret, and finds out by itself
which words and paths speak for or against one. Secrets never leave the operator: a finding holds their place
and a hash.

Labelled findings (candidate, before, after, path, label) are a table that the caller may bring;
``sample_findings`` makes one from shapes, with secrets of common kinds and the usual false alarms
(placeholders, checksums, identifiers, words, versions, links, addresses), forty of each and more. Training is
bounded by the table.

Row rules: null or empty text has no finding. A null path is an empty one; a null doc_id passes through. Texts and candidates may have any
length and are scored whole. A candidate that two patterns find is reported once; candidates that lie inside
others are reported too, in order of place, so there are no ties. Repeated rows are scanned one by one. An empty table gives no
findings. Extra columns pass through; those that have the names of the outputs are replaced, as by withColumn.
"""

from __future__ import annotations

import functools
import json
import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_names, default_vocabulary
from .common import others, small_batches
from .words import slices, tidy

CANDIDATE = re.compile(r"[A-Za-z0-9+/=_\-.]{16,}")
QUOTED = re.compile(r"""[\w.\-]{2,40}["']?\s{0,3}[:=]{1,2}\s{0,3}["']([^"'\n]{6,})["']""")
NAMED = re.compile(
    r"""(?i:token|secret|passw|pwd|key|auth|credential|private|access|bearer|api)[\w.\-]{0,40}["']?[ \t]{0,20}[:=]{1,2}[ \t]{0,20}"""
    r"""(?:(?i:bearer|basic|token)[ \t]{1,3})?([^\s"']{6,})"""
)
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
LONG, SHORT = 16, 6
NEAR = 40
TREES, DEPTH, SEED = 80, 14, 11
THRESHOLD = 0.5

#: Buckets of the hashed words before a candidate, around it, and of its path.
LEFT_BUCKETS, NEAR_BUCKETS, PATH_BUCKETS = 64, 64, 32
CLASSES = 5  # lower, upper, digit, punctuation, other


@functools.lru_cache(4)
def dictionary(path: str) -> frozenset[str]:
    """Lower-case words of four letters and more among a public vocabulary's tokens."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    names = byte_names()
    found = ("".join(chr(names[c]) for c in t).strip().lower() for t in vocab)
    return frozenset(w for w in found if len(w) >= 4 and w.isascii() and w.isalpha())


def char_class(c: str) -> int:
    return 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c.isascii() else 4


def pair_model(words: frozenset[str]) -> np.ndarray:
    """Log probability of each letter after each letter in dictionary words."""
    n = np.ones((26, 26))
    for w in words:
        for a, b in zip(w, w[1:]):
            n[ord(a) - 97, ord(b) - 97] += 1
    return np.log(n / n.sum(1, keepdims=True))


def coverage(s: str, words: frozenset[str]) -> float:
    """Share of the characters inside dictionary words, by longest match from the left."""
    s, i, got = s.lower(), 0, 0
    while i < len(s):
        for n in range(min(14, len(s) - i), 3, -1):
            if s[i : i + n] in words:
                got += n
                i += n
                break
        else:
            i += 1
    return got / max(1, len(s))


def buckets(text: str, n: int) -> list[float]:
    """How often words of the text fall into each of n buckets; a word's singular and plural share one."""
    out = [0.0] * n
    for w in re.findall(r"[a-z]+", text.lower()):
        out[zlib.crc32(w.removesuffix("s").encode()) % n] += 1.0
    return out


def features(candidate: str, before: str, after: str, path: str, words: frozenset[str], pairs: np.ndarray) -> list[float]:
    kinds = [char_class(c) for c in candidate]
    n = max(1, len(kinds))
    moves = Counter(zip(kinds, kinds[1:]))
    letters = [ord(c) - 97 for c in candidate.lower()]
    steps = [pairs[a, b] for a, b in zip(letters, letters[1:]) if 0 <= a < 26 and 0 <= b < 26]
    counts = Counter(candidate)
    name = re.search(r"([\w.\-]*)[\"']?\s*[:=]{0,2}\s*[\"']?$", before)[1]
    return [
        float(len(candidate)),
        -sum(v / n * math.log2(v / n) for v in counts.values()),
        len(counts) / n,
        *(kinds.count(k) / n for k in range(CLASSES)),
        *(moves[a, b] / max(1, n - 1) for a in range(4) for b in range(4)),
        float(np.mean(steps)) if steps else -3.3,
        len(steps) / n,
        coverage(candidate, words),
        float(all(c in "0123456789abcdefABCDEF" for c in candidate)),
        float(candidate.count("-") == 4 and len(candidate) == 36),
        float(before.rstrip()[-1:] in {"=", ":", '"', "'"}),
        float("://" in before[-12:] or "/" in candidate and "." in candidate),
        float("@" in candidate),
        float(candidate.count(" ")),
        *buckets(name, LEFT_BUCKETS),
        *buckets(f"{before} {after}", NEAR_BUCKETS),
        *buckets(path, PATH_BUCKETS),
    ]


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the candidates of a whole text, in order; one may lie inside another."""
    found = []
    if "=" in text or ":" in text:
        found += [m.span(1) for m in QUOTED.finditer(text)]
        for m in NAMED.finditer(text):
            a = m.start(1)
            # the value up to white space, and up to what may end it before
            for s in (m[1].rstrip(".,;:)]}"), re.split("[&,;]", m[1])[0]):
                if len(s) >= SHORT:
                    found.append((a, a + len(s)))
    for m in CANDIDATE.finditer(text):
        s = m[0].rstrip(".")
        if len(s) >= LONG and _DIGIT.search(s) and _LETTER.search(s):
            found.append((m.start(), m.start() + len(s)))
    return sorted(set(found))


def shapes(r: random.Random) -> tuple[list, list]:
    """(makers of secrets, (maker, what stands before) of false alarms), by public formats of credentials and of what looks
    like them; None before stands for any name."""
    lower, digit = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    upper, hexa = lower.upper(), digit + "abcdef"
    word = lower + upper + digit
    base64, url = word + "+/", word + "-_"
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    part = lambda k=2: "".join(r.choice(SYLLABLES) for _ in range(k))
    some = lambda *x: r.choice(x)
    secret = [
        # random strings by alphabet
        lambda: pick(hexa, some(32, 40, 64)),
        lambda: pick(hexa.upper(), some(32, 40, 64)),
        lambda: pick(word, r.randint(20, 64)),
        lambda: pick(lower + digit, r.randint(20, 50)),
        lambda: pick(upper + digit, r.randint(20, 40)),
        lambda: pick(base64, some(40, 44, 64)) + "=" * r.randint(0, 2),
        lambda: pick(base64, 86) + "==",
        lambda: pick(url, r.randint(20, 48)),
        lambda: pick(word + "!@#%^*", r.randint(12, 30)),
        # keys of services: a prefix and random characters
        lambda: some("AKIA", "ASIA") + pick(upper + "234567", 16),
        lambda: some("ghp_", "gho_", "ghs_") + pick(word, 36),
        lambda: "github_pat_" + pick(word, 22) + "_" + pick(word, 59),
        lambda: "glpat-" + pick(url, 20),
        lambda: some("xoxb-", "xoxp-") + pick(digit, 12) + "-" + pick(digit, 12) + "-" + pick(word, 24),
        lambda: some("sk_live_", "rk_live_", "sk_test_") + pick(word, 24),
        lambda: "AIza" + pick(url, 35),
        lambda: "SK" + pick(hexa, 32),
        lambda: "SG." + pick(url, 22) + "." + pick(url, 43),
        lambda: "npm_" + pick(word, 36),
        lambda: "pypi-" + pick(url, 70),
        lambda: "dop_v1_" + pick(hexa, 64),
        lambda: some("shpat_", "shpss_") + pick(hexa, 32),
        lambda: "key-" + pick(hexa, 32),
        lambda: "dapi" + pick(hexa, 32),
        lambda: "hf_" + pick(word, 34),
        lambda: "sq0csp-" + pick(url, 43),
        lambda: pick(digit, 10) + ":" + pick(url, 35),
        lambda: pick(word, 24) + "." + pick(word, 6) + "." + pick(url, 27),
        lambda: "eyJ" + pick(word, 17) + ".eyJ" + pick(url, 57) + "." + pick(url, 43),
        lambda: "EAA" + pick(word, 60),
        lambda: "ya29." + pick(url, 60),
        lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)),
        lambda: some("v1.", "s.", "hvs.") + pick(word, r.randint(24, 40)),
        # what people choose
        lambda: part(3).title() + pick(digit, 3) + pick("!@#$%", 2),
        lambda: part(2) + pick(digit, 2) + part(1),
        lambda: part(2).title() + pick(digit, 4),
        lambda: part(1).title() + some("!", "_", "#") + part(2) + pick(digit, 2),
        lambda: "-".join(part(2) for _ in range(4)) + pick(digit, 2),
        lambda: pick(lower, r.randint(8, 14)) + pick(digit, 2),
        # inside addresses and headers
        lambda: f"{part()}:{pick(word, 16)}",
        lambda: some("postgres", "mysql", "redis") + f"://{part()}:{pick(word, 14)}@{part()}.example.com:{pick(digit, 4)}",
        lambda: "Basic " + pick(base64, 28) + "=",
    ]
    alarm = [
        # placeholders and references stand where a secret would
        (lambda: some("changeme", "your-token-here", "xxxxxxxxxxxxxxxx", "<password>", "example_key_123456", "0123456789abcdef", "test_secret_value_1"), None),
        (lambda: some("${", "{{ ") + "_".join(part().upper() for _ in range(2)) + some("}", " }}"), None),
        (lambda: some("os.environ", "process.env", "env") + "." + "_".join(part().upper() for _ in range(r.randint(2, 3))), None),
        (lambda: some("x", "*", "0", "-") * r.randint(8, 32), None),
        (lambda: "_".join(part() for _ in range(r.randint(2, 5))) + pick(digit, 2), None),
        (lambda: part(1) + "".join(part().title() for _ in range(r.randint(2, 4))) + pick(digit, 1), None),
        (lambda: ".".join(part() for _ in range(r.randint(2, 4))) + "()", None),
        # digests and identifiers, named as such
        (lambda: pick(hexa, some(32, 40, 64)), ["commit ", "revision ", 'commit: "', "merge of ", "head at "]),
        (lambda: pick(hexa, some(32, 40, 64)), ["sha256: ", 'checksum = "', "md5 ", "digest: ", "sha1="]),
        (lambda: pick(hexa, some(32, 40, 64)), ["hash of ", 'etag="', 'hash: "', "fingerprint ", 'fingerprint: "']),
        (lambda: "sha512-" + pick(base64, 86) + "==", ['integrity: "', "integrity ", '"integrity": "']),
        (lambda: "sha256:" + pick(hexa, 64), ["image: ", 'digest = "', "pulled "]),
        (lambda: "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12)), ["uuid: ", 'id = "', "request id ", "trace=", 'session_id: "', 'guid: "']),
        (lambda: pick(hexa, 24), ['_id: "', "object id ", 'id: "', "node "]),
        (lambda: pick(hexa, 16) + some("", "-" + pick(hexa, 16)), ["trace ", 'span_id = "', "trace_id=", 'request: "']),
        (lambda: pick(upper + digit, 8) + "-" + pick(digit, 6), ['order: "', "invoice ", 'ticket = "', "number "]),
        (lambda: "-".join(pick(upper + digit, 5) for _ in range(4)), ['serial: "', "product ", 'model = "', "serial number "]),
        (lambda: pick(digit, some(16, 18, 20)) + pick(lower, 1), ["account ", 'number = "', "row ", 'line: "']),
        (lambda: ":".join(pick(hexa, 2) for _ in range(some(6, 16, 20))), ["mac ", 'fingerprint: "', "address "]),
        # versions, places, times
        (lambda: "v" + ".".join(str(r.randint(0, 40)) for _ in range(3)) + "-" + part(3), ['version = "', "version ", 'release: "']),
        (lambda: part() + "-" + ".".join(str(r.randint(0, 40)) for _ in range(3)) + "-py3-none-any.whl", ["wheel ", 'file = "', "download "]),
        (lambda: "/".join(part() for _ in range(r.randint(2, 5))) + "." + pick(lower, 3), ["https://", 'file: "', 'url = "', "path="]),
        (lambda: "https://" + part() + ".example.com/" + part() + "/" + pick(digit, 6), ['url = "', "see ", 'link: "', 'href="']),
        (lambda: "s3://" + part() + "-" + part() + "/" + part() + "/" + pick(digit, 8), ['bucket: "', "copied ", 'path = "']),
        (lambda: "arn:aws:iam::" + pick(digit, 12) + ":role/" + part(), ['role = "', "arn ", 'resource: "']),
        (lambda: f"{pick(digit, 4)}-{pick(digit, 2)}-{pick(digit, 2)}T{pick(digit, 6)}Z", ["at ", 'date = "', "time: "]),
        (lambda: f"{pick(digit, 4)}-{pick(digit, 2)}-{pick(digit, 2)}-{part()}-{part()}", ["branch ", 'file: "', 'title = "']),
        (lambda: ".".join(str(r.randint(1, 254)) for _ in range(4)) + ":" + pick(digit, 4), ["host ", 'address: "', 'server = "']),
        # words and text
        (lambda: " ".join(part(r.randint(1, 3)) for _ in range(r.randint(2, 5))), ['name = "', 'title: "', 'message = "', 'note="']),
        (lambda: " ".join(part(r.randint(1, 3)) for _ in range(r.randint(3, 7))) + ".", ['text: "', 'description = "', 'label: "', 'error = "']),
        (lambda: f"{part()}.{pick(digit, 2)}@{part()}{pick(digit, 1)}.example.com", ["mail ", 'contact: "', ""]),
        (lambda: part() + "=" + pick(digit, r.randint(4, 12)) + "." + part(), ["", "? ", 'query = "']),
        (lambda: part() + "-" + part() + "-" + part() + "-" + pick(digit, 2), ['class="', 'class: "', "style "]),
        (lambda: "data:image/png;base64,iVBORw0KGgo" + pick(base64, 60), ['src="', 'icon: "', 'image = "']),
        (lambda: "SELECT " + part() + " FROM " + part() + " WHERE id=" + pick(digit, 4), ['query = "', 'sql: "', "run "]),
        (lambda: part().title() + "-" + part().title() + "/" + ".".join(pick(digit, 1) for _ in range(3)), ['agent: "', 'user_agent = "', "client "]),
        (lambda: part() + "_" + part() + "_" + pick(digit, 8) + ".log", ["wrote ", 'log: "', 'output = "']),
        (lambda: "+" + pick(digit, 2) + " " + pick(digit, 3) + " " + pick(digit, 7), ['phone: "', "call ", 'fax = "']),
        (lambda: "ISBN" + pick(digit, 13) + pick("X", 1), ['isbn = "', "book ", 'code: "']),
        (lambda: "#" + ",#".join(pick(hexa, 6) for _ in range(3)), ['color: "', 'palette = "', "colors "]),
    ]
    return secret, alarm


SYLLABLES = ["th", "an", "er", "on", "re", "en", "st", "con", "ment", "ver", "ing", "la", "do", "que", "sch", "ion", "ta", "pro", "light", "cket", "ser", "data", "ho", "us", "mar", "net"]


def sample_findings(n: int = 6000, seed: int = SEED, use: Callable[[int], bool] = lambda k: True) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (candidate, before, after, path, label) of the shapes whose number ``use`` takes, half of them secrets.

    Shapes of both kinds are numbered from 0.
    """
    r = random.Random(seed)
    prose = lambda k: " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(k))
    secret, alarm = (list(x for k, x in enumerate(made) if use(k)) for made in shapes(r))
    names = ["token", "api_key", "secret", "password", "auth_token", "access_key", "private_key", "client_secret", "pwd", "credential", "bearer", "signing_key"]
    plain = ["name", "value", "field", "label", "column", "key", "item", "part"]
    paths = ["src/app.py", "config/prod.env", "deploy.yaml", "tests/test_app.py", "docs/readme.md", "package-lock.json", "src0", "src7", ""]
    out = []
    for k in range(n):
        ctx = prose(r.randint(1, 6))
        if k % 2:
            quote = r.choice(['"', '"', "'", ""])
            before = f'{ctx} {r.choice(names)}{r.choice([" = ", ": ", "=", " := "])}{quote}'
            out.append((r.choice(secret)(), before, f"{quote} {prose(3)}", r.choice(paths), 1))
        else:
            make, lead = r.choice(alarm)
            before = f"{ctx} " + (r.choice(lead) if lead else f'{r.choice([*names, *plain])} = "')
            out.append((make(), before, f'" {prose(3)}', r.choice(paths), 0))
    return out


def train(findings: DataFrame, vocabulary: str | None = None, trees: int = TREES, depth: int = DEPTH):
    """Random forest over the features of labelled findings (candidate, before, after, path, label)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    words = findings.sparkSession.sparkContext.broadcast(dictionary(vocabulary or default_vocabulary()))

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pair_model(words.value)
        for b in batches:
            rows = zip(*(b.column(k).to_pylist() for k in range(4)))
            x = [features(c or "", p or "", a or "", w or "", words.value, pairs) for c, p, a, w in rows]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(4)], names=["x", "label"])

    cols = ["candidate", "before", "after", "path", F.col("label").cast("double").alias("label")]
    known = findings.where("label is not null").select(*cols).mapInArrow(run, "x array<double>, label double")
    known = known.select(array_to_vector("x").alias("features"), "label")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, subsamplingRate=0.8)
    return forest.fit(known)


OUTPUTS = ["begin", "stop", "candidate_sha256", "score"]


def scan(docs: DataFrame, model, text: str = "text", path: str | None = None, keep: list[str] | None = None, vocabulary: str | None = None) -> DataFrame:
    """One row per candidate: the columns ``keep``, begin, stop (code points), candidate_sha256, score."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    small_batches(docs.sparkSession)
    keep = others([c for c in docs.columns if c != text] if keep is None else keep, *OUTPUTS)
    words = docs.sparkSession.sparkContext.broadcast(dictionary(vocabulary or default_vocabulary()))
    where = F.col(path).cast("string") if path else F.lit("")
    # under names that no column of the model has
    held = [F.col(f"`{c}`").alias(f"kept_{k}") for k, c in enumerate(keep)]
    df = docs.select(*held, F.coalesce(where, F.lit("")).alias("path"), F.col(text).alias("text"))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields[:-2]), "begin long, stop long, candidate_sha256 string, x array<double>"])

    @tidy()
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        pairs = pair_model(words.value)
        for b in slices(batches, len(keep) + 1):
            row, begin, stop, digest, x = [], [], [], [], []
            for k, (p, t) in enumerate(zip(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist())):
                for i, j in candidates(t or ""):
                    row.append(k)
                    begin.append(i)
                    stop.append(j)
                    digest.append(hashlib.sha256(t[i:j].encode("utf-8", "surrogatepass")).hexdigest())
                    x.append(features(t[i:j], t[max(0, i - NEAR) : i], t[j : j + NEAR], p, words.value, pairs))
            take = pa.array(row, pa.int64())
            found = [pa.array(begin, pa.int64()), pa.array(stop, pa.int64()), pa.array(digest, pa.string()), pa.array(x, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(take) for k in range(len(keep))), *found], names=[*b.schema.names[:-2], *OUTPUTS[:3], "x"])

    found = df.mapInArrow(run, schema).withColumn("features", array_to_vector("x")).drop("x")
    scored = model.setFeaturesCol("features").transform(found)
    back = [F.col(f"kept_{k}").alias(c) for k, c in enumerate(keep)]
    return scored.select(*back, *OUTPUTS[:3], vector_to_array("probability")[1].alias("score"))


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Every candidate of every document: doc_id, begin, stop, candidate_sha256, score, is_secret."""
    labelled = spark.createDataFrame(sample_findings(), "candidate string, before string, after string, path string, label int")
    model = train(labelled)
    found = scan(docs.select("doc_id", "text", "source"), model, path="source", keep=["doc_id"])
    return found.withColumn("is_secret", F.col("score") >= THRESHOLD)
