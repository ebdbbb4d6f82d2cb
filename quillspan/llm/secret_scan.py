"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds to them.

Patterns find assignments, access keys and long hexadecimal runs; their spans
always stay. The field tags tokens (runs of key characters or of other letters,
and every other character by itself) as begin, inside or outside of a secret,
from the token's shape, a hash of its letters, the same of its neighbours, and
features of the whole text. What it tags and no pattern's span touches is added,
whatever its length or characters, if the odds for it are `MARGIN` or more.

It is trained here, by adaptive gradient steps on the exact likelihood, on a
bounded sample: `sample` texts (the first by a hash of the text, half of them with
words that the patterns know), each of which gives one stretch of `STRETCH`
characters, at a place that the hash draws from the whole text, or around one of
its patterns' values. The values are tagged; to stretches without any, a secret in
another wording and, another time, something that only looks like one (`_training_secrets`,
`_decoys`) is added, so that the field learns what values and their surroundings
look like and not the patterns.

Decoding is exact Viterbi. The chain is cut at tokens that are outside on every
best path: where outside leads by more than the transitions around the token, and
making the next token begin instead of inside, could cost (`Field.decode`). The
stretches between go through the recursion side by side.

Null is the empty text, which has no spans. Very long texts are scanned whole,
one at a time. Offsets count code points, ends are exclusive. Rows are independent
of each other: equal texts, equal spans. An empty table gives no rows. `scanned`
does not read columns beside doc_id and text; `redacted` keeps all.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.arrays import mix, small, starts_of, tidy, written

KINDS = ("assign", "access", "hex", "crf")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
_ACCESS_RUN, _HEX_RUN = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))

SAMPLE, STRETCH, STEPS, RATE, DIMS = 1000, 240, 60, 0.5, 1 << 13
#: Log odds that a span needs over being outside.
MARGIN = 0.5
#: Share of numbers in groups among what only looks like a secret.
GROUPED = 0.35
_KIND = np.full(256, 2, np.uint8)  # 0 space, 1 key character or letter, 2 by itself
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", *range(128, 256)]] = 1
_TYPE = np.zeros(256, np.int64)  # 1 lower, 2 upper, 3 digit, 4 other key character, 5 beyond ASCII
_TYPE[list(range(97, 123))], _TYPE[list(range(65, 91))], _TYPE[list(range(48, 58))] = 1, 2, 3
_TYPE[[*b"+/_-"]], _TYPE[128:] = 4, 5


def base_spans(text: str, raw: bytes) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns; raw is the text's UTF-8."""
    out = []
    low = raw.translate(_LOW)
    if any(k in low for k in (b"passw", b"secret", b"token", b"api")):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in raw:
        out += [(m.start(), m.end(), "access") for m in _ACCESS_RUN.finditer(text)]
    out += [(m.start(), m.end(), "hex") for m in _HEX_RUN.finditer(text)]
    return out


class Tokens:
    """Tokens of some texts and their features.

    `start`, `end` are bytes in `buf`, `text` the text's number. `features` has a
    column of feature ids for each feature kind; a weight row per id.
    """

    def __init__(self, texts: list[bytes]):
        self.buf = buf = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
        self.at = np.append(starts_of(np.array([len(t) + 1 for t in texts], np.int64)), len(buf))
        kind = _KIND[buf]
        new = (kind > 0) & ((kind == 2) | (np.concatenate([[0], kind[:-1]]) != 1))
        self.start = np.flatnonzero(new)
        stop = (kind > 0) & ((kind == 2) | (np.concatenate([kind[1:], [0]]) != 1))
        self.end = np.flatnonzero(stop) + 1
        self.text = np.searchsorted(self.at, self.start, side="right") - 1
        n = len(self.start)
        if not n:
            self.features, self.shape = np.zeros((0, 9), np.int64), np.zeros(0, np.int64)
            return
        types = _TYPE[buf]
        one = np.zeros(len(buf) + 1, np.int64)

        def count(mask: np.ndarray) -> np.ndarray:
            np.cumsum(mask, out=one[1:])
            return one[self.end] - one[self.start]

        length = self.end - self.start
        lower, upper, digit, other, far = (count(types == k) for k in range(1, 6))
        change = count(np.concatenate([[False], (types[1:] != types[:-1]) & (types[1:] > 0)]))
        size = np.minimum(np.searchsorted([2, 4, 8, 12, 16, 20, 24, 32, 40, 64], length, side="right"), 10)
        some = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (other > 0) + 16 * (far > 0)
        share = np.minimum(4 * digit // np.maximum(length, 1), 3)
        mixed = np.minimum(6 * change // np.maximum(length, 1), 5)
        self.shape = some + 32 * (size + 11 * share)
        single = length == 1
        letters = np.where(single, buf[self.start].astype(np.int64), 0)
        # Letters of the token, in either case, hashed; digits count alike, so that values do not get weights of their own.
        value = np.where(types == 3, 1, np.where(types == 2, buf + 32, buf)).astype(np.uint64)
        inside = np.arange(length.sum()) - np.repeat(starts_of(length), length)
        solid = kind > 0
        word = mix(np.add.reduceat(mix(value[solid] + (inside.astype(np.uint64) << np.uint64(9))), starts_of(length)))
        word = np.where(digit > 2, np.uint64(0), word)
        tokens_in = np.bincount(self.text, minlength=len(texts))
        rich = np.bincount(self.text, weights=(digit > 2) & (length >= 8), minlength=len(texts))
        file = np.minimum(np.searchsorted([30, 300], tokens_in), 2) + 3 * np.minimum(np.searchsorted([1, 4], rich, side="right"), 2)

        def near(x: np.ndarray, k: int) -> np.ndarray:
            out = np.full(n, 999_983, x.dtype)
            if k > 0:
                out[k:] = np.where(self.text[k:] == self.text[:-k], x[:-k], 999_983) if n > k else out[k:]
            else:
                out[:k] = np.where(self.text[:k] == self.text[-k:], x[-k:], 999_983) if n > -k else out[:k]
            return out

        w = word.view(np.int64)
        mark = letters + 512 * self.shape
        parts = [mark, mixed + 8 * size + 128 * some, w, near(w, 1), near(w, 2), near(mark, 1), near(mark, -1), near(w, 3), file[self.text] + 16 * self.shape]
        self.features = np.stack([(mix(p.astype(np.int64).view(np.uint64) + np.uint64(k * 7_919 + 1)) % np.uint64(DIMS)).astype(np.int64) for k, p in enumerate(parts)], axis=1)


class Field:
    """Weights: `emit` (DIMS, 3) summed over a token's features, `move` (3, 3), `begin` (3). Tags: 0 outside, 1 begin, 2 inside."""

    FORBIDDEN = -1e4

    def __init__(self):
        self.emit, self.move, self.begin = np.zeros((DIMS, 3)), np.zeros((3, 3)), np.zeros(3)
        self.move[0, 2] = self.begin[2] = self.FORBIDDEN

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3))
        for column in features.T:
            out += self.emit[column]
        return out

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, rate: float = RATE) -> Field:
        """Gradient steps (AdaGrad) on the likelihood of the (features, tags), all sequences at once, the longest first."""
        sequences = sorted(sequences, key=lambda s: -len(s[1]))
        size = np.array([len(t) for _, t in sequences])
        n, most = len(sequences), int(size[0])
        own = [int((size > t).sum()) for t in range(most)]  # sequences that have a token t: these come first
        first = starts_of(size)
        # Tokens by place, so that the tokens of one place are neighbours.
        order = np.concatenate([first[:k] + t for t, k in enumerate(own)])
        feats = np.concatenate([f for f, _ in sequences])[order].T.copy()
        tags = np.concatenate([t for _, t in sequences])[order]
        begin = np.append(0, np.cumsum(own))
        at = [slice(begin[t], begin[t + 1]) for t in range(most)]
        gold = np.eye(3)[tags]
        pair_gold = sum((gold[at[t]][: own[t + 1]].T @ gold[at[t + 1]] for t in range(most - 1)), np.zeros((3, 3)))
        squares = [np.full_like(x, 1e-2) for x in (self.emit, self.move, self.begin)]
        for _ in range(steps):
            e = np.zeros((len(tags), 3))
            for column in feats:
                e += self.emit[column]
            e = np.exp(e - e.max(axis=1, keepdims=True))
            move, start = np.exp(self.move), np.exp(self.begin)
            # Forward and backward in probabilities, scaled at each place.
            alpha, beta, scale = np.empty_like(e), np.ones_like(e), np.empty((len(tags), 1))
            for t in range(most):
                a = (start if t == 0 else alpha[at[t - 1]][: own[t]] @ move) * e[at[t]]
                scale[at[t]] = a.sum(axis=1, keepdims=True)
                alpha[at[t]] = a / scale[at[t]]
            pair = np.zeros((3, 3))
            for t in range(most - 2, -1, -1):
                after = e[at[t + 1]] * beta[at[t + 1]] / scale[at[t + 1]]
                k = own[t + 1]
                beta[at[t]][:k] = after @ move.T
                pair += alpha[at[t]][:k].T @ after
            d = (gold - alpha * beta) / n
            grads = [np.empty_like(self.emit), (pair_gold - pair * move) / n, d[at[0]].sum(axis=0)]
            for tag in range(3):
                grads[0][:, tag] = np.bincount(feats.ravel(), weights=np.tile(d[:, tag], len(feats)), minlength=DIMS)
            grads[0] -= 1e-4 * self.emit
            for x, g, s in zip((self.emit, self.move, self.begin), grads, squares, strict=True):
                s += g * g
                x += rate * g / np.sqrt(s)
            self.move[0, 2] = self.begin[2] = self.FORBIDDEN
        return self

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags of one sequence with emission scores e (tokens, 3)."""
        best, back = e[0] + self.begin, []
        for row in e[1:]:
            all_moves = best[:, None] + self.move
            back.append(all_moves.argmax(axis=0))
            best = all_moves.max(axis=0) + row
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return np.array(tags[::-1])

    def odds(self, e: np.ndarray) -> float:
        """How much better (in log probability) one span over these tokens is than none, between outside tokens."""
        n = len(e)
        inside = e[0, 1] + e[1:, 2].sum() + self.move[0, 1] + (self.move[1, 2] + (n - 2) * self.move[2, 2] + self.move[2, 0] if n > 1 else self.move[1, 0])
        return float(inside - e[:, 0].sum() - (n + 1) * self.move[0, 0])

    def decode(self, features: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Tags of all tokens: Viterbi per text.

        A token is outside on every best path if outside leads by more than three
        transitions can differ (before it, after it, and after its successor) and
        than begin lacks to inside at its successor: any path that tags it
        otherwise is then improved by tagging it outside and, as outside is not
        followed by inside, an inside successor begin.
        """
        return self.best_tags(self.scores(features), text)

    def best_tags(self, e: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Viterbi per text over emission scores e (tokens, 3)."""
        tags, n = np.zeros(len(e), np.int64), len(e)
        allowed = np.append(self.move[self.move > self.FORBIDDEN / 2], self.begin[:2])
        follows = np.append(text[1:] == text[:-1], False) if n else np.zeros(0, bool)
        owed = np.zeros(n)
        owed[:-1] = np.where(follows[:-1], np.maximum(0, e[1:, 2] - e[1:, 1]), 0)
        sure = e[:, 0] - e[:, 1:].max(axis=1) > 3 * (allowed.max() - allowed.min()) + owed + 1e-9
        at = np.flatnonzero(~sure)
        if not len(at):
            return tags
        cut = np.flatnonzero((np.diff(at) > 1) | (text[at[1:]] != text[at[:-1]]))
        begin, size = at[np.append(0, cut + 1)], np.diff(np.concatenate([[0], cut + 1, [len(at)]]))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        last = begin + size - 1
        # Beside a stretch lies an outside token of its text, or the text's edge.
        left, right = (begin > 0) & follows[begin - 1], follows[last]
        best = np.where(left[:, None], self.move[0], self.begin) + e[begin]
        back: list[np.ndarray] = []
        for k in range(1, int(size[0])):
            own = int(np.searchsorted(-size, -k))  # stretches of more than k tokens come first
            moves = best[:own, :, None] + self.move
            back.append(moves.argmax(axis=1))
            best[:own] = moves.max(axis=1) + e[begin[:own] + k]
        tag = (best + np.where(right[:, None], self.move[:, 0], 0)).argmax(axis=1)
        for k in range(int(size[0]) - 1, 0, -1):
            own = len(back[k - 1])
            tags[begin[:own] + k] = tag[:own]
            tag[:own] = back[k - 1][np.arange(own), tag[:own]]
        tags[begin] = tag
        return tags


_HEX, _CAPITALS = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
_ALPHANUMERIC = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _random(rng: np.random.Generator, chars: str, low: int, high: int) -> str:
    return "".join(chars[k] for k in rng.integers(len(chars), size=rng.integers(low, high + 1)))


def _training_secrets(rng: np.random.Generator) -> tuple[str, str, str]:
    """(before, value, after) of a secret in a wording that the field should also know."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    key = pick(["password", "passwd", "pwd", "passphrase", "pass phrase", "secret", "client secret", "shared secret", "token", "access token", "auth token", "refresh token", "bearer", "Authorization: Bearer", "api key", "private key", "signing key", "credential", "credentials", "login", "login key", "passcode", "auth"])
    kind = rng.integers(8)
    if kind == 0:
        value = _random(rng, _HEX, 16, 31)
    elif kind == 1:
        value = pick(["ghp_", "sk_live_", "sk-", "xoxb-", "glpat-", "npm_", "key-", "tok_"]) + _random(rng, _ALPHANUMERIC, 12, 40)
    elif kind == 2:
        value = _random(rng, _ALPHANUMERIC + "+/", 20, 60) + pick(["", "=", "=="])
    elif kind == 3:
        value = ".".join(_random(rng, _ALPHANUMERIC + "_-", 10, 30) for _ in range(3))
    elif kind == 4:
        value = "-".join(_random(rng, pick([_HEX, _CAPITALS]), 4, 8) for _ in range(rng.integers(3, 6)))
    elif kind == 5:
        value = _random(rng, _ALPHANUMERIC, 5, 9) + pick("!#$%&*?@") + _random(rng, _ALPHANUMERIC, 2, 6)
    else:
        value = _random(rng, pick([_CAPITALS, _ALPHANUMERIC, _ALPHANUMERIC + "_-"]), 10, 40)
    if rng.random() < 0.15:
        return f"{pick(['use', 'with', 'enter', 'try'])} ", value, f" as {pick(['the', 'your', 'our'])} {key}"
    lead = pick(["", "", "the ", "The ", "my ", "your ", "new ", "old "])
    return lead + key + pick([" = ", "=", ": ", ":", " is ", " is: ", " was ", " ", " := ", " -> ", " => ", " (", " set to "]) + pick(["", "", "", '"', "'", "`"]), value, pick(["", "", "", ".", ",", '"', "'", ")", ";"])


def _grouped(rng: np.random.Generator) -> str:
    """Numbers in groups, as telephones, cards, accounts, identities and addresses have them, with and without a word before."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    digits = lambda n: "".join(map(str, rng.integers(10, size=n)))
    gap, country = pick([" ", "-", "."]), pick(["+1 ", "+1-", "+1", "+44 ", "+49 ", "+33 ", "00", "", ""])
    number = pick([
        f"{country}({digits(3)}) {digits(3)}{pick('- .')}{digits(4)}", f"{country}{digits(3)}{gap}{digits(3)}{gap}{digits(4)}", f"{country}({digits(3)}){digits(7)}", f"{country}{digits(2)} {digits(4)} {digits(4)}",
        gap.join(digits(4) for _ in range(4)), digits(16), f"{digits(4)} {digits(6)} {digits(5)}", f"{digits(3)}-{digits(2)}-{digits(4)}", f"{pick(['DE', 'FR', 'GB'])}{digits(2)} {' '.join(digits(4) for _ in range(4))} {digits(2)}",
        ".".join(str(rng.integers(256)) for _ in range(4)), f"{digits(2)}/{digits(2)}/{digits(4)}", f"{digits(5)}-{digits(4)}",
    ])
    return pick(["", "", "call ", "Call: ", "tel. ", "Phone: ", "phone ", "fax ", "at ", "card ", "Card: ", "card number ", "IBAN ", "SSN ", "id ", "ip ", "reach us at ", "or "]) + number + pick(["", "", ".", ",", ";", ")"])


def _decoys(rng: np.random.Generator, words: list[str]) -> str:
    """What looks a little like a secret and is none: key words in prose, numbers, dates, names, paths, versions."""
    pick = lambda xs: xs[rng.integers(len(xs))]
    word, other, n = pick(words), pick(words), int(rng.integers(1, 10**9))
    if rng.random() < GROUPED:
        return _grouped(rng)
    return pick([
        f"the secret {word} {other}", f"a token of {word}", f"password is {word}", f"the key {word} of {other}", f"forgot the password: {word} {other}", f"login as {word}", f"api key for {word}",
        f"order {n}", f"id {n}", f"call +49 {n % 1000} {n}", f"{n % 31 + 1}.{n % 12 + 1}.20{n % 90 + 10}", f"20{n % 90 + 10}-{n % 12 + 1:02d}-{n % 28 + 1:02d}T{n % 24:02d}:{n % 60:02d}:00Z", f"version {n % 20}.{n % 7}.{n % 13}",
        f"https://www.{word}.com/{other}/{n}", f"{word}.{other}@{pick(words)}.org", f"/usr/{word}/{other}{n % 100}.txt", f"{word.capitalize()}{other.capitalize()}", f"{word}_{other}_{n % 100}", f"{word.upper()}-{n % 1000}", f"${n % 100_000}.{n % 100:02d}", f"{n % 100}x{n % 50} {word}", f"ISBN 978-{n % 10}-{n % 10_000:04d}-{n % 9999:04d}-{n % 10}",
    ])


def training_sequences(stretches: list[tuple[str, list[tuple[int, int]]]], seed: int = 11) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, tags) of stretches of texts with their values' places; those without any also with an added secret, and with a decoy."""
    rng = np.random.default_rng(seed)
    made, spans = [], []

    def add(text: str, marks: list[tuple[int, int]]) -> None:
        made.append(text.encode("utf-8", "replace"))
        spans.append([(len(text[:a].encode("utf-8", "replace")), len(text[:b].encode("utf-8", "replace"))) for a, b in marks])

    words = sorted({w.strip(".,!?") for t, _ in stretches for w in t.split(" ")[1:-1] if w.strip(".,!?").isalpha()}) or ["word"]
    for text, marks in stretches:
        add(text, marks)
        if marks:
            continue
        for real in (True, False):
            cut = int(rng.integers(0, len(text) + 1))
            head, tail = text[:cut].rpartition(" ")[0], text[cut:].partition(" ")[2]
            if real:
                before, value, after = _training_secrets(rng)
                head = f"{head} {before}" if head else before
                add(f"{head}{value}{after} {tail}", [(len(head), len(head) + len(value))])
            else:
                add(f"{head} {_decoys(rng, words)} {tail}", [])
    tokens, out = Tokens(made), []
    bounds = np.searchsorted(tokens.text, np.arange(len(made) + 1))
    for k, marks in enumerate(spans):
        i, j = bounds[k], bounds[k + 1]
        if i == j:
            continue
        tags = np.zeros(j - i, np.int64)
        start = tokens.start[i:j] - tokens.at[k]
        for a, b in marks:
            mine = np.flatnonzero((start >= a) & (start < b))
            tags[mine] = 2
            tags[mine[:1]] = 1
        out.append((tokens.features[i:j], tags))
    return out


def stretch_of(text: str, h: int, size: int = STRETCH) -> tuple[str, list[tuple[int, int]]]:
    """A stretch of a text at a place drawn by h, and the places of the patterns' values in it; around a value where the text has any."""
    found = []
    for a, b, kind in base_spans(text, text.encode("utf-8", "surrogatepass")):
        found.append(_ASSIGN.match(text, a).span(2) if kind == "assign" else (a, b))
    if found:
        a, b = found[h % len(found)]
        size = max(size, b - a + 120)
        at = max(0, a - (h // 7) % (size - (b - a)))
    else:
        at = h % max(1, len(text) - size + 1)
    return text[at : at + size], [(a - at, b - at) for a, b in found if at <= a and b <= at + size]


def train(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field from docs(text). One pass finds which texts to learn from, a second one fetches their stretches."""
    words = r"(?i)(password|passwd|secret|token|api_?key|AKIA[A-Z0-9]{12})"
    rows = docs.where("text is not null").select("text", F.xxhash64("text").alias("h"))
    narrow = written(rows.select("h", F.col("text").rlike(words).alias("hit")))
    chosen = [r.h for hit in (True, False) for r in narrow.where(F.col("hit") == hit).select("h").distinct().orderBy("h").limit(sample // 2).collect()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = [stretch_of(t, h & 0x7FFFFFFFFFFFFFFF) for t, h in zip(b.column("text").to_pylist(), b.column("h").to_pylist(), strict=True)]
            marks = [[x for pair in m for x in pair] for _, m in found]
            yield pa.RecordBatch.from_arrays([b.column("h"), pa.array([t for t, _ in found], pa.string()), pa.array(marks, pa.list_(pa.int32()))], names=["h", "text", "marks"])

    # Of equal texts all rows give the same stretch: one stays.
    got = rows.where(F.col("h").isin(chosen)).mapInArrow(tidy(cut), "h long, text string, marks array<int>").groupBy("h").agg(F.min(F.struct("text", "marks")).alias("s")).collect() if chosen else []
    stretches = [(r.s.text, list(zip(r.s.marks[::2], r.s.marks[1::2], strict=True))) for r in sorted(got, key=lambda r: r.h)]
    sequences = training_sequences(stretches or [("a b c", [])])
    return Field().fit(sequences)


def added_spans(field: Field, texts: list[bytes]) -> list[list[tuple[int, int]]]:
    """Byte spans in each text that the field tags."""
    tokens = Tokens(texts)
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if not len(tokens.start):
        return out
    scores = field.scores(tokens.features)
    tags = field.best_tags(scores, tokens.text)
    hit = np.flatnonzero(tags == 1)
    for i in hit.tolist():
        j = i
        while j + 1 < len(tags) and tags[j + 1] == 2 and tokens.text[j + 1] == tokens.text[i]:
            j += 1
        if field.odds(scores[i : j + 1]) < MARGIN:
            continue
        k = int(tokens.text[i])
        out[k].append((int(tokens.start[i]) - int(tokens.at[k]), int(tokens.end[j]) - int(tokens.at[k])))
    return out


def all_spans(field: Field, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """(start, end, kind) in code points, sorted; the field's spans are left out where they touch a pattern's."""
    raws, out = [t.encode("utf-8", "surrogatepass") for t in texts], []
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(raws[end]) < 1 << 18):
            size += len(raws[end])
            end += 1
        for t, raw, more in zip(texts[begin:end], raws[begin:end], added_spans(field, raws[begin:end]), strict=True):
            base = base_spans(t, raw)
            if more and len(raw) != len(t):
                more = [(len(raw[:a].decode("utf-8", "surrogatepass")), len(raw[:b].decode("utf-8", "surrogatepass"))) for a, b in more]
            own = [(a, b, "crf") for a, b in more if all(b <= x or a >= y for x, y, _ in base)]
            out.append(sorted(base + own, key=lambda s: (s[0], KINDS.index(s[2]))))
        begin = end
    return out


def scanned(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_crf, base_sha256, spans) of every row of docs(doc_id, text)."""
    field = field or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            found = all_spans(field, [t or "" for t in b.column("text").to_pylist()])
            counts = [pa.array([sum(s[2] == k for s in spans) for spans in found], pa.int64()) for k in KINDS]
            told = [",".join(f"{k}:{i}:{j}" for i, j, k in spans) for spans in found]
            base = [",".join(f"{k}:{i}:{j}" for i, j, k in spans if k != "crf") for spans in found]
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(sha, pa.string()), pa.array(told, pa.string())], names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string")


def redacted(docs: DataFrame, field: Field | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs(text, ...) with every found span replaced by `mark`; a column n_chars follows the new text."""
    field = field or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches):
            texts, out = b.column("text").to_pylist(), []
            for t, spans in zip(texts, all_spans(field, [t or "" for t in texts]), strict=True):
                done, at = [], 0
                for i, j, _ in spans:
                    if i >= at:
                        done += [t[at:i], mark]
                    at = max(at, j)
                out.append("".join([*done, t[at:]]) if spans else t)
            columns = [pa.array(out, pa.string()) if n == "text" else pa.array([None if t is None else len(t) for t in out], b.schema.field(n).type) if n == "n_chars" else b.column(n) for n in b.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(tidy(run), docs.schema)
