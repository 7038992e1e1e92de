"""Secrets in texts: patterns propose candidates, a random forest trained on labelled findings removes false positives.

No table of findings is given, so the labelled rows are made here: true ones by the published shapes of keys in the usual
surroundings, false ones by what such patterns also meet (hashes, ids, numbers, addresses, placeholders, long words).
The number of rows and the seed are parameters; held-out rows measure the forest.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, query
from .forest import grow, share

LABELLED = 4000
SEED = 7
LEAST_SHARE = 0.5
#: Characters on either side whose words are looked at.
NEAR = 40
RUN = re.compile("[A-Za-z0-9+/_=-]{16,}")
_KEY = r"pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key"
# the password of an address; or a name that holds a key word, and all of its value; or else a run. An address and a name
# start where their runs start, so a run is read once.
CANDIDATE = re.compile(
    r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]*+://[^\s/:@\"'<>]*+:(?P<url>[^\s/@\"'<>]{4,}+)@|"
    rf"(?<![A-Za-z0-9+/_=-])(?P<lead>[A-Za-z0-9+/_=-]*?)(?i:{_KEY})(?:[_-](?:(?!(?i:pass|pwd|secret|token|api[_-]?key))[A-Za-z0-9_-])*+)?"
    r"[\"']?\s{0,3}(?::=|=>|[:=])\s{0,3}[\"']?(?P<value>[^\s\"'<>]{8,}+)|"
    + RUN.pattern
)
DIGIT = re.compile("[0-9]")
# Words near keys, words near things that only look like keys, and key prefixes in use.
SECRET_WORDS = frozenset("access api apikey auth authorization aws bearer credential credentials key pass passphrase passwd password private pwd secret token".split())
HARMLESS_WORDS = frozenset("checksum commit digest doi etag example hash id image isbn md5 order placeholder revision sample sha sha1 sha256 test uuid version".split())
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "sk-", "rk_live_", "xoxb-", "xoxp-", "AIza", "eyJ", "npm_", "SG.", "hf_", "pypi-")
DICTIONARY = frozenset(
    "about account address admin after align application array background before block border button center class client color column commit config container content "
    "default description display document element error event example false field file filter font footer format function global header height hidden image index information "
    "input integer international label language layout length level library license line link list local message method model module name network number object option order "
    "package page panel param parent password path place placeholder point position process program project property public query record reference region release report request "
    "response result return right sample script search section select server service session setting source standard static status string style system table target template "
    "test text time title token type update user value variable vector version view width window word world your".split()
)
TEST_PATHS = re.compile(r"(?i)test|example|fixture|mock|sample|docs?/|readme")
LETTERS, HEX = string.ascii_letters + string.digits, "0123456789abcdef"
_WORD = re.compile("[A-Za-z0-9]+")


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def _covered(value: str) -> float:
    """Share of letters in dictionary words, longest first from the left."""
    low, i, hit = value.lower(), 0, 0
    while i < len(low):
        for n in range(min(13, len(low) - i), 3, -1):
            if low[i : i + n] in DICTIONARY:
                hit, i = hit + n, i + n
                break
        else:
            i += 1
    return hit / max(1, sum(c.isalpha() for c in value))


def features(value: str, before: str, after: str, path: str) -> list[float]:
    """Length, characters and their transitions, dictionary coverage, neighbouring words and path of a candidate."""
    n = len(value)
    kinds = [_kind(c) for c in value]
    share_of = [kinds.count(k) / n for k in range(4)]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1)
    vowels = sum(a in "aeiouAEIOU" for a in value) / n
    alternating = sum((a in "aeiou") != (b in "aeiou") for a, b in zip(value.lower(), value[1:].lower()) if a.isalpha() and b.isalpha()) / max(1, n - 1)
    counts = Counter(value)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values())
    near = [w.lower() for w in _WORD.findall(before)[-4:]]
    later = [w.lower() for w in _WORD.findall(after)[:2]]
    address = bool(re.search(r"://[^\s/:@\"'<>]*:$", before))
    assigned = bool(re.search(r"[:=]>?\s*[\"']?$", before)) or bool(re.match(r"^[A-Za-z_]+=", value))
    return [
        n, *share_of, changes, vowels, alternating, entropy, len(counts) / n, _covered(value), sum(w in SECRET_WORDS for w in near), sum(w in HARMLESS_WORDS for w in near + later),
        float(assigned), float(value.startswith(PREFIXES)), float(set(value.lower()) <= set(HEX)), float(n in (32, 40, 64)), float(value.count("-") == 4), max(len(x) for x in re.split("[^A-Za-z]", value)) / n,
        float(bool(TEST_PATHS.search(path))), float(before[-1:] in "\"'"), float(address), float(any(c in "$({[," for c in value)),
    ]


def labelled_findings(rows: int = LABELLED, seed: int = SEED) -> tuple[list[tuple[str, str, str, str]], np.ndarray]:
    """Made findings (value, before, after, path) and whether each is a secret."""
    rng = np.random.default_rng(seed)
    words = sorted(DICTIONARY)
    take = lambda letters, n: "".join(letters[i] for i in rng.integers(0, len(letters), n))
    one = lambda xs: xs[int(rng.integers(0, len(xs)))]
    prose = lambda: " ".join(take("aeiou" * 3 + string.ascii_lowercase, rng.integers(2, 10)) for _ in range(5)) + " "
    upper = string.ascii_uppercase + string.digits
    keys = [
        lambda: "AKIA" + take(upper, 16), lambda: "ASIA" + take(upper, 16), lambda: one(["ghp_", "gho_", "ghs_"]) + take(LETTERS, 36), lambda: "sk_live_" + take(LETTERS, 24),
        lambda: "AIza" + take(LETTERS + "_-", 35), lambda: "xoxb-" + take(string.digits, 11) + "-" + take(LETTERS, 24), lambda: "eyJ" + take(LETTERS + "_-", 60), lambda: "hf_" + take(LETTERS, 34),
    ]
    values = [lambda: take(HEX, one([32, 40, 40, 64])), lambda: take(LETTERS, rng.integers(20, 48)), lambda: take(LETTERS + "+/", 40), lambda: take(LETTERS + "_-", rng.integers(16, 40))]
    upper_or = lambda w: one([w, w, w.title(), w.upper()])
    digits = lambda a, b: take(string.digits, rng.integers(a, b))
    mark = lambda: take("!#$%&*@_.-", 1)
    syllables = lambda a, b: take("aeiou" * 3 + string.ascii_lowercase, rng.integers(a, b))
    # what people choose: words with digits or marks in them
    chosen = [
        lambda: upper_or(one(words)) + digits(1, 4) + upper_or(one(words)), lambda: upper_or(syllables(4, 9)) + digits(1, 4) + upper_or(syllables(4, 9)), lambda: upper_or(one(words)) + mark() + digits(2, 5),
        lambda: upper_or(syllables(5, 10)) + digits(2, 5) + one(["", mark()]), lambda: syllables(3, 6).title() + mark() + syllables(3, 6).title() + digits(1, 4), lambda: take(LETTERS + "!#$%&*@", rng.integers(8, 20)),
    ]
    private = ["password", "passwd", "pwd", "pass", "passphrase", "DB_PASSWORD", "secret", "db_pwd", "the password"]
    schemes = ["postgres", "mysql", "mongodb+srv", "redis", "amqp", "https", "ftp"]
    lead = ["token", "secret", "api_key", "apikey", "password", "access_key", "auth_token", "private_key", "AWS_SECRET_ACCESS_KEY", "client_secret"]
    false = [
        lambda: (take(HEX, 40), prose() + one(["commit ", "revision ", "sha1: ", "hash ", "at "])), lambda: (take(HEX, one([32, 64])), prose() + one(["md5 = ", "checksum: ", "sha256:", "digest=\"", "etag: \""])),
        lambda: ("-".join(take(HEX, n) for n in (8, 4, 4, 4, 12)), prose() + one(["id: ", "uuid = \"", "id=", "request ", ""])), lambda: (take(string.digits, rng.integers(16, 24)), prose() + one(["", "order ", "id ", "card ", "no. "])),
        lambda: ("-".join(one(words) for _ in range(rng.integers(3, 5))) + take(string.digits, 2), prose() + one(["class=\"", "", "see "])), lambda: ("_".join(one(words) for _ in range(3)) + take(string.digits, 1), prose()),
        lambda: ("".join(one(words).title() for _ in range(3)) + take(string.digits, 2), prose() + one(["", "function ", "key "])), lambda: (one(["your_api_key_here_123", "xxxxxxxxxxxxxxxx0000", "EXAMPLE_TOKEN_12345", "0000000000000000", "changeme_password_1", "1234567890123456"]), prose() + one(lead) + " = \""),
        lambda: ("/".join(one(words) for _ in range(4)) + take(string.digits, 1), prose() + one(["/", "path ", "https:/"])), lambda: (take("aeiou" * 3 + string.ascii_lowercase, rng.integers(15, 24)) + take(string.digits, 1), prose()),
        lambda: (f"{take(string.digits, 4)}-{take(string.digits, 2)}-{take(string.digits, 2)}T{take(string.digits, 6)}", prose() + one(["time ", "date: ", ""])), lambda: (take(one(["=", "-", "_"]), rng.integers(16, 60)) + "1", prose()),
        lambda: (syllables(8, 24), prose() + one(lead + private) + one([" = \"", ": ", "="])),
        lambda: (one(words) + one(["", "_", "-"]) + one(words), prose() + one(lead + private) + one([" = \"", ": ", "=", " = "])),
        lambda: (one(["os.environ.get", "getenv", "process.env.", "config.", "settings.", "self.", "${", "{{", "$(", "args."]) + one(words) + one(["", "_", "("]) + one(words) + one(["", ")", "}", "}}", ","]), prose() + one(lead + private) + one([" = ", ": ", "="])),
        lambda: (one(["********", "xxxxxxxx", "changeme", "password", "undefined", "required,", "........", "redacted", "[REDACTED]", "null,null"]), prose() + one(lead + private) + one([" = \"", ": ", "=", " = "])),
    ]
    out, y = [], np.zeros(rows)
    for i in range(rows):
        if i % 2 == 0:
            kind = rng.random()
            if kind < 0.35:
                value, before = one(keys)(), prose() + one(["", one(lead) + " = \"", one(lead) + ": ", ""])
            elif kind < 0.6:
                value = one(chosen)()
                while len(value) < 8:
                    value += digits(1, 3)
                before = prose() + one(private) + one([" = \"", "=", ": ", ": \"", " = "])
            elif kind < 0.7:
                value, before = one([*chosen, *values])(), prose() + one(schemes) + "://" + syllables(3, 8) + ":"
            else:
                value, before = one(values)(), prose() + one(lead) + one([" = \"", "=", ": ", ": \"", " ", "=\""])
            path, y[i] = one(["src0", "src1", "config.env", "app.py"]), 1
        else:
            (value, before), path = one(false)(), one(["src0", "src1", "config.env", "app.py", "tests/a.py", "docs/x"])
        out.append((value, before[-NEAR:], one(["\" ", " ", "\n"]) + prose()[:NEAR], path))
    return out, y


def trained(rows: int = LABELLED, seed: int = SEED) -> list[np.ndarray]:
    findings, y = labelled_findings(rows, seed)
    return grow(np.array([features(*f) for f in findings]), y, seed)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans to judge, by start. Runs inside the value of a key word follow it; they count if the value is no secret."""
    out = []
    for m in CANDIDATE.finditer(text):
        spans = [m.span()]
        if m.group("url"):
            out.append(m.span("url"))
            spans = []
        elif m.group("value"):
            out += [x.span() for x in RUN.finditer(text, *m.span("lead")) if DIGIT.search(text, *x.span())]
            out.append(m.span("value"))
            spans = [x.span() for x in RUN.finditer(text, *m.span("value")) if x.span() != m.span("value")]
        out += [x for x in spans if DIGIT.search(text, *x)]
    return out


def _confirmed(spans: list[tuple[int, int]], scores: list[float]) -> list[dict]:
    """The spans that are secrets, without those inside one before."""
    out = []
    for (a, b), s in zip(spans, scores):
        if s >= LEAST_SHARE and not (out and a < out[-1]["end"]):
            out.append({"start": a, "end": b, "score": s})
    return out


def _scan(forest: list[np.ndarray], extra: list[str]):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, paths = batch.column("_text").to_pylist(), batch.column("_path").to_pylist()
            spans = [candidates(t) for t in texts]
            rows = [features(t[a:b], t[max(0, a - NEAR) : a], t[b : b + NEAR], p) for t, p, own in zip(texts, paths, spans) for a, b in own]
            score = iter(share(forest, np.array(rows)).tolist() if rows else [])
            found = [_confirmed(own, [next(score) for _ in own]) for own in spans]
            clean = [_redacted(t, own) for t, own in zip(texts, found)]
            count = pa.array([len(own) for own in spans], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in extra), count, pa.array(found, kind), pa.array(clean, pa.string())], names=[*extra, "n_candidates", "secrets", "clean_text"])

    return run


def _redacted(text: str, spans: list[dict]) -> str:
    out, at = [], 0
    for x in spans:
        out += [text[at : x["start"]], "[SECRET]"]
        at = x["end"]
    return "".join([*out, text[at:]]) if spans else text


def secrets(docs: DataFrame, keep: list[str], path: str = "source", labelled: int = LABELLED, seed: int = SEED) -> DataFrame:
    """`keep` columns of `docs` (text, and `path` if there) with n_candidates, secrets (start, end in code points, score)
    and clean_text, where each secret is replaced by [SECRET].

    A null text has no candidates and an empty clean_text; a null or absent path counts as "". Rows are independent:
    repeated rows and ids give repeated results. The forest is grown once on the driver from `labelled` made rows.
    """
    spots = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"), (F.coalesce(F.col(path).cast("string"), F.lit("")) if path in docs.columns else F.lit("")).alias("_path"))
    names = [f"_k{i}" for i in range(len(keep))]  # names that clash with nothing
    spots = spots.toDF(*names, "_text", "_path")
    kinds = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, docs.select(*keep).schema)]
    schema = ", ".join([*kinds, "n_candidates long, secrets array<struct<start:long,end:long,score:double>>, clean_text string"])
    return spots.mapInArrow(_scan(trained(labelled, seed), names), schema).toDF(*keep, "n_candidates", "secrets", "clean_text")


@query("op2_secret_scan")
def op2(spark, folder):
    found = secrets(documents(spark, folder).select("doc_id", "text", "source"), ["doc_id"])
    each = found.select("doc_id", F.explode("secrets").alias("x"))
    return each.select("doc_id", F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.round("x.score", 6).alias("score"))
