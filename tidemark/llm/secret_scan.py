"""Secret scan: candidate strings in whole texts, false positives removed by a random forest.

Candidates are (a) values after ``:`` or ``=``, (b) unbroken runs of 16 or
more key characters with a digit or an issuer's prefix, (c) private key blocks.
Values and runs inside longer values (query strings, connection URLs, nested
settings) are candidates as well. Each is described
by its length, character transitions, dictionary coverage (words of its own
document and common words), path shape and neighbouring words, all taken over
the whole candidate, however long; the forest decides. It is trained from labelled findings, a bounded table (``LABELLED``
rows). As no labelled findings are given, ``labelled_findings`` draws them
from the shapes listed below, with neighbouring words in the way of logs,
configuration and prose; ``train`` takes any other labelled table.

Spans count code points of the whole text. ``scan`` gives findings, ``redact``
replaces the secrets' spans and keeps every row.

Defined cases: null and empty texts have no findings and stay as they are;
repeated rows are scanned each; null ids are kept. All candidates are scored;
overlapping secrets are then merged into one span, and of the others those
apart from secrets stay, the first and longest of them. Extra columns pass
through ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import nullable, rows_at_once, whole

LABELLED, TREES, DEPTH, SEED = 4000, 32, 9, 11

# fixed values: words next to secrets, words next to look-alikes, common words, prefixes of issued keys
SECRET_WORDS = ("password passwd pwd pass passphrase secret token apikey api_key api-key accesskey access_key "
                "auth authorization bearer credential credentials private_key client_secret key").split()
BENIGN_WORDS = ("commit sha sha1 sha256 md5 checksum digest hash revision uuid guid id isbn tel phone fax card "
                "order invoice version build ticket serial tracking iban account session trace etag").split()
COMMON_WORDS = ("password secret token example sample change changeme your here test demo dummy default value "
                "user name none null true false required placeholder file path index page image static assets "
                "config get set the and for with this that from data main server client").split()
PREFIXES = re.compile(r"AKIA[0-9A-Z]{16}$|ASIA[0-9A-Z]{16}$|gh[pousr]_|xox[abprs]-|sk[-_]live|AIza|eyJ|glpat-|npm_")
RUN = re.compile(r"[A-Za-z0-9+/_\-]{16,}={0,2}")
VALUE = re.compile(r"[:=]>?[ \t]{0,3}[\"']?([^\s\"'<>,;]{6,})")
# a framed key; without its end, the header and the key lines that follow it
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:(?!-----)[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----"
                 r"|(?:\s+[A-Za-z0-9+/=]{40,})+)")
INNER = re.compile(r"[:=](?=[^:=]{6})")      # a sign in a value with a value behind it
PIECE = re.compile(r"[^:=&?#@]{6,}={0,2}")   # up to the next part of a query or URL
IN_URL = re.compile(r"://[^=?&#:]*$")        # host or path, not behind a parameter's sign
USERINFO = re.compile(r"://[^\s/@]*:$")      # the password's place in a connection URL
LEFT = re.compile(r"[A-Za-z0-9_\-]+")
LETTERS = re.compile(r"[a-z]{4,}")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")

FEATURES = ("length digits letters uppers turns distinct entropy vowels alternation covered slashes dots hexes "
            "only_digits uuid issued assigned quoted near_secret near_benign url mail pem").split()


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


@dataclass
class Tail:
    """Character statistics of ``text[at:end]``; ``reach`` moves the start to the left and reads only what is new."""
    text: str
    end: int

    def __post_init__(self):
        self.at, self.counts = self.end, Counter()
        self.spread = 0.0   # sum of count * log2(count)
        self.kinds, self.turns, self.alpha, self.vowels, self.changes = [0] * 4, 0, 0, 0, 0
        self.hexes, self.slashes, self.dots, self.ats, self.covered = 0, 0, 0, 0, 0
        self.first_kind = self.first_vowel = None

    def reach(self, start: int, dictionary: Dictionary) -> None:
        new = self.text[start : self.at]
        if not new:
            return
        low = new.lower()
        for c, n in Counter(new).items():
            old = self.counts[c]
            self.counts[c] = old + n
            self.spread += (old + n) * log2(old + n) - (old * log2(old) if old else 0.0)
        kinds = [_kind(c) for c in new]
        for k in range(4):
            self.kinds[k] += kinds.count(k)
        self.turns += sum(a != b for a, b in zip(kinds, kinds[1:]))
        self.turns += self.first_kind is not None and kinds[-1] != self.first_kind
        self.first_kind = kinds[0]
        vowel = [c in "aeiouy" for c in low if c.isalpha()]
        if vowel:
            self.changes += sum(a != b for a, b in zip(vowel, vowel[1:]))
            self.changes += self.first_vowel is not None and vowel[-1] != self.first_vowel
            self.first_vowel = vowel[0]
        self.alpha += len(vowel)
        self.vowels += sum(vowel)
        self.hexes += sum(c in "0123456789abcdef" for c in low)
        self.slashes += new.count("/")
        self.dots += new.count(".")
        self.ats += new.count("@")
        self.covered += sum(len(w) for w in LETTERS.findall(low) if dictionary.covers(w))
        self.at = start


class Dictionary:
    """Words by which letters count as covered: one of them, or two side by side."""

    def __init__(self, words: set[str]):
        self.words, self.lengths = words, {len(w) for w in words}

    def covers(self, w: str) -> bool:
        n = len(w)
        return w in self.words or any(
            4 <= k <= n - 4 and n - k in self.lengths and w[:k] in self.words and w[k:] in self.words
            for k in self.lengths)


def features(tail: Tail, dictionary: Dictionary, pem: bool = False) -> list[float]:
    """Numbers that describe one whole candidate, ``tail``'s span, and the texts beside it."""
    text, s, e = tail.text, tail.at, tail.end
    left, right, n = text[max(0, s - 60) : s], text[e : e + 20], e - s
    login = right[:1] == "@" and bool(USERINFO.search(left))
    near = [w.lower() for w in LEFT.findall(left)[-4:]]
    parts = [q for w in near[-2:] for q in (w, *re.split(r"[_\-]", w))]
    return [
        n, tail.kinds[0] / n, tail.alpha / n, tail.kinds[2] / n, tail.turns / max(n - 1, 1),
        len(tail.counts) / n, max(log2(n) - tail.spread / n, 0.0), tail.vowels / max(tail.alpha, 1),
        tail.changes / max(tail.alpha - 1, 1), tail.covered / n, tail.slashes, tail.dots, tail.hexes / n,
        float(tail.kinds[0] == n), float(n == 36 and bool(UUID.fullmatch(text, s, e))),
        float(bool(PREFIXES.match(text, s, e))), float(bool(re.search(r"[:=]>?\s{0,3}[\"']?$", left))),
        float(left[-1:] in "\"'" and left != ""), float(login or any(w in SECRET_WORDS for w in parts)),
        float(any(w in BENIGN_WORDS for w in near)),
        float(bool(IN_URL.search(left[-30:])) or text.startswith("//", s, e)),
        float(tail.ats > 0 or (right[:1] == "@" and not login)), float(pem)]


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans ``(start, end, kind)`` of one whole text, in order, the longest first; they can overlap."""
    found = []
    if "-----BEGIN " in text:
        found += [(m.start(), m.end(), "pem") for m in PEM.finditer(text)]
    if ":" in text or "=" in text:
        for m in VALUE.finditer(text):
            if re.search(r"[A-Za-z0-9_\-\"']\s{0,3}$", text[max(0, m.start() - 4) : m.start()]):
                found.append((m.start(1), m.end(1), "value"))
            for i in INNER.finditer(text, m.start(1), m.end(1)):
                found.append((i.end(), m.end(1), "value"))
                if piece := PIECE.match(text, i.end(), m.end(1)):
                    found.append((piece.start(), piece.end(), "value"))
    at = 0
    for w in text.split():
        if len(w) >= 16:
            at = text.index(w, at)
            for m in RUN.finditer(w):
                if any(c.isdigit() for c in m[0]) or PREFIXES.match(m[0]):
                    found.append((at + m.start(), at + m.end(), "run"))
                if "/" in m[0]:  # issued keys as parts of a path
                    found += [(at + m.start() + q.start(), at + m.start() + q.end(), "run")
                              for q in re.finditer(r"[^/]{16,}", m[0]) if PREFIXES.match(q[0])]
            at += len(w)
    first: dict[tuple[int, int], str] = {}
    for a, b, kind in found:
        first.setdefault((a, b), kind)
    return sorted(((a, b, kind) for (a, b), kind in first.items()), key=lambda f: (f[0], -f[1]))


def apart(spans: list[tuple[int, int, str]], p: np.ndarray, threshold: float):
    """Scored spans without overlaps: secrets united, then what of the others lies apart from them."""
    secrets: list[tuple[int, int, str, float]] = []
    for (a, b, kind), q in zip(spans, p):
        if q >= threshold:
            if secrets and a < secrets[-1][1]:
                s = secrets[-1]
                secrets[-1] = (s[0], max(s[1], b), s[2], max(s[3], q))
            else:
                secrets.append((a, b, kind, q))
    out, end, k = list(secrets), 0, 0
    for (a, b, kind), q in zip(spans, p):
        while k < len(secrets) and secrets[k][1] <= a:
            k += 1
        if q < threshold and a >= end and (k == len(secrets) or b <= secrets[k][0]):
            out.append((a, b, kind, q))
            end = b
    out.sort(key=lambda f: f[0])
    return [f[:3] for f in out], np.array([f[3] for f in out])


def describe(text: str, spans: list[tuple[int, int, str]]) -> np.ndarray:
    """Features of every span, whole. Spans inside each other that end together are read once, from their end on."""
    outside, at = [], 0
    for s, e, _ in spans:
        outside.append(text[at:s])
        at = max(at, e)
    outside.append(text[at:])
    dictionary = Dictionary(set(COMMON_WORDS).union(*(LETTERS.findall(o.lower()) for o in outside)))
    x = np.empty((len(spans), len(FEATURES)))
    by_end: dict[int, Tail] = {}
    for i in sorted(range(len(spans)), key=lambda i: -spans[i][0]):  # spans of one end: the shortest first
        s, e, kind = spans[i]
        tail = by_end.setdefault(e, Tail(text, e))
        tail.reach(s, dictionary)
        x[i] = features(tail, dictionary, kind == "pem")
    return x


# ---------------------------------------------------------------- forest

@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), threshold, left child, right child, share of secrets."""
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feat, cut, left, right, share in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                f = feat[node]
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[node]
                node = np.where(f < 0, node, np.where(go, left[node], right[node]))
            total += share[node]
        return total / max(len(self.trees), 1)


def _split(x: np.ndarray, y: np.ndarray, cols: np.ndarray):
    best = (1e-9, -1, 0.0)
    base = y.mean() * (1 - y.mean()) * len(y)
    for c in cols:
        order = np.argsort(x[:, c], kind="stable")
        v, t = x[order, c], y[order]
        ones, n = np.cumsum(t)[:-1], np.arange(1, len(t))
        rest = len(t) - n
        impurity = ones * (1 - ones / n) + (t.sum() - ones) * (1 - (t.sum() - ones) / rest)
        gain = np.where(v[1:] > v[:-1], base - impurity, -1.0)
        k = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[k] > best[0]:
            best = (float(gain[k]), int(c), float((v[k] + v[k + 1]) / 2))
    return best[1], best[2]


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
    """Bootstrapped trees of Gini splits over random subsets of the features."""
    rng, out = np.random.default_rng(seed), []
    some = max(1, round(x.shape[1] ** 0.5) + 1) if len(x) else 1
    for _ in range(trees if len(x) else 0):
        rows = rng.integers(0, len(x), len(x))
        nodes: list[list[float]] = []

        def add(at: np.ndarray, level: int) -> int:
            me = len(nodes)
            nodes.append([-1, 0.0, 0, 0, float(y[at].mean())])
            if level < depth and len(at) >= 4 and 0 < y[at].mean() < 1:
                f, cut = _split(x[at], y[at], rng.choice(x.shape[1], some, replace=False))
                if f >= 0:
                    go = x[at, f] <= cut
                    nodes[me][:4] = [f, cut, add(at[go], level + 1), add(at[~go], level + 1)]
            return me

        add(rows, 0)
        a = np.array(nodes)
        out.append((a[:, 0].astype(np.int64), a[:, 1], a[:, 2].astype(np.int64), a[:, 3].astype(np.int64), a[:, 4]))
    return Forest(out)


def labelled_findings(n: int = LABELLED, seed: int = SEED) -> pd.DataFrame:
    """``(text, start, end, kind, secret)``: one labelled finding per text, drawn from shapes."""
    rng = np.random.default_rng(seed)
    hexes, digit = "0123456789abcdef", "0123456789"
    lower = "abcdefghijklmnopqrstuvwxyz"
    mixed = lower + lower.upper() + digit
    pick = lambda xs: xs[rng.integers(len(xs))]
    some = lambda chars, a, b=None: "".join(pick(chars) for _ in range(rng.integers(a, (b or a) + 1)))
    syll = ["th", "er", "on", "an", "ing", "ver", "lich", "que", "eau", "cion", "ado", "re", "en", "st", "ti", "ou"]
    word = lambda: "".join(pick(syll) for _ in range(rng.integers(1, 5)))
    prose = lambda: " ".join(word() for _ in range(rng.integers(0, 5)))
    secret_key = lambda: pick(["", "db_", "DB_", "my-", "app."]) + pick(SECRET_WORDS[:-1])
    sign = lambda: pick(["=", " = ", ": ", ":", '="', ' = "', ': "', "='"])
    dash = lambda *k: "-".join(some(hexes, i) for i in k)
    yes = [
        lambda: (pick(["", "", "key ", "aws_access_key_id="]), pick(["AKIA", "ASIA"]) + some(lower.upper() + "234567", 16)),
        lambda: (secret_key() + sign(), some(hexes, 16, 64)), lambda: (secret_key() + sign(), some(mixed, 10, 44)),
        lambda: (secret_key() + sign(), some(mixed + "!$%&*+-_@#", 8, 24)),
        lambda: ("", pick(["ghp_", "gho_", "ghs_"]) + some(mixed, 36)),
        lambda: ("", pick(["xoxb-", "xoxp-"]) + some(digit, 11) + "-" + some(mixed, 24)),
        lambda: ("", "sk_live_" + some(mixed, 24)), lambda: ("", "AIza" + some(mixed + "-_", 35)),
        lambda: (pick(["", "Bearer "]), "eyJ" + some(mixed + "-_", 40, 120)),
        lambda: (pick(["secret ", "key ", "token "]), some(mixed + "+/", 32, 48))]
    no = [
        lambda: (pick(["commit ", "sha1 ", "md5: ", "checksum=", "digest: sha256 ", "revision "]), some(hexes, 32, 64)),
        lambda: (pick(["", "id ", "uuid=", "token id: "]), dash(8, 4, 4, 4, 12)),
        lambda: (pick(["", "", "card ", "order ", "call ", "iban "]), some(digit, 16, 22)),
        lambda: (pick(["https://", "see http://", "url="]), word() + ".example.com/" + word() + "/" + some(digit, 2, 6)),
        lambda: ("", "/".join(["", *(word() for _ in range(4)), "v" + some(digit, 1, 2)])),
        lambda: ("", "_".join(word() for _ in range(3)) + "_" + some(digit, 2, 4)),
        lambda: ("", word() + word().title() + word().title() + some(digit, 1, 3) + "Config"),
        lambda: (secret_key() + sign(), pick(["changeme", "your_password_here", "xxxxxxxx", "********", "example",
                                              "required", "placeholder", "<token>", "${TOKEN}", "getToken()"])),
        lambda: (secret_key() + sign(), word() + word() + word()),
        lambda: (word() + sign(), word() + word() + word()),
        lambda: (word() + ": ", word() + "." + word() + "." + word() + "()"),
        lambda: (pick(["at ", "", "time: "]), "20" + some(digit, 2) + "-0" + pick(digit[1:]) + "-1" + pick(digit) + "T10:22:31Z"),
        lambda: (pick(["version: ", "build="]), some(digit, 2) + "." + some(digit, 2) + "." + some(digit, 3) + "-" + word()),
        lambda: ("mail: ", word() + word() + some(digit, 1, 4) + "@example.com"),
        lambda: (pick(["", "a"]) + "=", "=" * int(rng.integers(8, 30)) + some(digit, 1))]
    rows = []
    for i in range(n):
        label = int(i % 2)
        left, value = pick(yes if label else no)()
        before = prose()
        before += " " * bool(before) + left
        text = before + value + pick(["", " ", '" ', ". "]) + prose()
        rows.append((text, len(before), len(before) + len(value), "value" if left.rstrip(" \"'")[-1:] in ":=" else "run", label))
    return pd.DataFrame(rows, columns=["text", "start", "end", "kind", "secret"])


def train(findings: pd.DataFrame | None = None) -> Forest:
    """Forest from labelled findings (at most ``LABELLED`` rows, in the order given)."""
    f = (labelled_findings() if findings is None else findings).head(LABELLED)
    if not len(f):
        return Forest([])
    x = np.concatenate([describe(r.text, [(r.start, r.end, r.kind)]) for r in f.itertuples()])
    return grow(x, f["secret"].to_numpy(np.float64))


def _found(text: str | None, forest: Forest, threshold: float):
    spans = candidates(text) if text else []
    if not spans:
        return [], np.empty(0)
    x = describe(text, spans)
    # a private key block is a secret by its frame
    return apart(spans, np.maximum(forest.score(x), x[:, -1]), threshold)


def scan(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> DataFrame:
    """``(doc_id, start, length, kind, score, is_secret, sha256)``: one row per span, apart from each other."""
    rows_at_once(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest)  # at most TREES * 2**(DEPTH+1) nodes

    def run(frames: Iterator[pd.DataFrame]):
        for pdf in frames:
            rows = []
            for i, t in zip(pdf["doc_id"], pdf["text"]):
                spans, p = _found(t, shared.value, threshold)
                rows += [(i, s, e - s, k, float(q), bool(q >= threshold),
                          hashlib.sha256(t[s:e].encode("utf-8", "surrogatepass")).hexdigest())
                         for (s, e, k), q in zip(spans, p)]
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "kind", "score", "is_secret",
                                                  "sha256"])

    out = docs.select(whole("doc_id"), "text").mapInPandas(
        run, "doc_id long, start long, length long, kind string, score double, is_secret boolean, sha256 string")
    return out.withColumn("doc_id", nullable("doc_id"))


def redact(docs: DataFrame, forest: Forest, mark: str = "[SECRET]", threshold: float = 0.5) -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by ``mark``; ``n_chars``, where there is one, follows."""
    rows_at_once(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("string")
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            out = []
            for t in s:
                spans, p = _found(t, shared.value, threshold)
                for (a, b, _), q in reversed(list(zip(spans, p))):
                    if q >= threshold:
                        t = t[:a] + mark + t[b:]
                out.append(t)
            yield pd.Series(out, dtype=object)

    out = docs.withColumn("text", clean(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)
