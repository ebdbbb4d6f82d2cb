import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from quillspan.llm.secret_scan import Field, Tokens, redacted, scanned, train


def base(text):
    out = []
    for m in re.finditer(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, b, k in sorted(out)]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(8)
    words = "the of tion ing ére über año thon stre".split()
    rows = []
    for i in range(260):
        w = [r.choice(words) for _ in range(r.choice([0, 5, 60, 400]))]
        hexed = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([7, 8, 18, 31, 32, 40])))
        for s in r.sample([f"password={hexed}", f'Token = "{hexed}"', "AKIA" + "".join(r.choice("AB12") for _ in range(r.choice([11, 12, 16]))), "api_key: 'abcdefgh", "SECRET:abc", "apikey=ABCDEFGH12", hexed * 2, "ſecret=abcdefghij", "AKIAAKIA1AKIA0000"], r.choice([0, 0, 1, 2])):
            w.insert(r.randrange(len(w) + 1), s)
        rows.append((i, r.choice([" ", "\n"]).join(w)))
    return rows + [(900, None), (901, ""), (902, "clé é password=12345678é token=abcdefghi"), (3, rows[3][1])]


def test_base_spans_and_redaction(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").selectExpr("*", "length(text) as n_chars", "'x' as spans", "1 as base_sha256").repartition(3)
    field = train(df)
    out = scanned(df, field).collect()
    assert len(out) == len(corpus)
    texts = {}
    for d, t in corpus:
        texts.setdefault(d, t or "")
    for x in out:
        want = base(texts[x.doc_id])
        assert [x.n_assign, x.n_access, x.n_hex] == [sum(k == y for y, *_ in want) for k in ("assign", "access", "hex")]
        assert x.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [s for s in x.spans.split(",") if s and not s.startswith("crf")] == [f"{k}:{a}:{b}" for k, a, b in want]
    clean = redacted(df, field).collect()
    for x in clean:
        assert (x.text is None) == (x.doc_id == 900) and (x.text is None or x.n_chars == len(x.text))
        assert not base(x.text or "")
        if not base(texts[x.doc_id]) and "[SECRET]" not in (x.text or ""):
            assert (x.text or "") == texts[x.doc_id]


def test_field_generalizes(spark, corpus):
    field = train(spark.createDataFrame(corpus, "doc_id long, text string"))
    from quillspan.llm.secret_scan import all_spans

    found = all_spans(field, ["the of pwd is Xk29dkEEwq0192Lpqa tion", "the of tion ing ére über año"])
    assert "crf" in [k for *_, k in found[0]] and found[1] == []


def test_decoding_is_viterbi():
    """Over 1,500 draws of weights and scores, close to and far from those of trained fields, cut decoding equals the whole recursion."""
    for seed in range(1500):
        r = np.random.default_rng(seed)
        field = Field()
        field.move += r.normal(0, r.choice([0.2, 1, 3]), (3, 3))
        field.begin += r.normal(0, 1, 3)
        field.move[0, 2] = field.begin[2] = field.FORBIDDEN
        sizes = r.integers(1, 12, 4)
        e = r.normal(0, r.choice([1, 4, 12]), (sizes.sum(), 3))
        e[:, 0] += r.choice([0, 3, 10])
        text = np.repeat(np.array([0, 1, 3, 4]), sizes)
        got = field.best_tags(e, text)
        for k in (0, 1, 3, 4):
            assert (got[text == k] == field.viterbi(e[text == k])).all(), seed


def test_decoding_of_texts():
    r = np.random.default_rng(0)
    field = Field()
    field.emit[:, 0] = 2
    field.emit += r.normal(0, 1.2, field.emit.shape)
    texts = [" ".join(f"{a}x{b}=" for a, b in r.integers(0, 50, (30, 2))).encode() for _ in range(9)]
    tokens = Tokens(texts)
    got = field.decode(tokens.features, tokens.text)
    for k in range(len(texts)):
        mine = tokens.text == k
        assert (got[mine] == field.viterbi(field.scores(tokens.features[mine]))).all()


def test_probabilities_by_brute_force():
    """The scaled recursions give the likelihood's gradient: one step moves as by differences over all taggings."""
    r = np.random.default_rng(5)
    x = Tokens([b"ab 12 cd", b"x9"])
    feats = [x.features[x.text == k] for k in (0, 1)]
    tags = [np.array([0, 1, 2]), np.array([1])]
    field = Field()
    field.emit += r.normal(0, 0.5, field.emit.shape)
    field.move += r.normal(0, 0.5, (3, 3))
    field.move[0, 2] = field.FORBIDDEN

    def likelihood(move):
        total = 0
        for f, t in zip(feats, tags):
            e = field.scores(f)
            value = lambda path: field.begin[path[0]] + sum(e[i, p] for i, p in enumerate(path)) + sum(move[p, q] for p, q in zip(path, path[1:]))  # noqa: E731, B023
            every = [value(path) for path in itertools.product(range(3), repeat=len(t))]
            total += value(list(t)) - np.logaddexp.reduce(every)
        return total / 2

    before, step = field.move.copy(), 1e-5
    slopes = np.zeros((3, 3))
    for i, j in itertools.product(range(3), repeat=2):
        up, down = before.copy(), before.copy()
        up[i, j] += step
        down[i, j] -= step
        slopes[i, j] = (likelihood(up) - likelihood(down)) / (2 * step)
    field.fit(list(zip(feats, tags)), steps=1)
    moved = field.move - before
    want = 0.5 * slopes / np.sqrt(1e-2 + slopes**2)
    want[0, 2] = moved[0, 2] = 0
    assert np.allclose(moved, want, atol=1e-6)


def test_field_finds_held_out_secrets_that_the_patterns_miss(spark, corpus):
    """Wordings and values not seen in training: recall, exact bounds, and no spans in texts without secrets."""
    from quillspan.llm.secret_scan import all_spans

    field = train(spark.createDataFrame(corpus, "doc_id long, text string"))
    r = random.Random(12)
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    draw = lambda n, c=chars: "".join(r.choice(c) for _ in range(n))
    words = [w for _, t in corpus for w in (t or "").split() if w.isalpha()]
    hit = exact = wrong = 0
    for _ in range(400):
        key = r.choice(["vault code is", "the deploy key", "session cookie:", "wifi pass", "private token is", "cert key:", "robot account uses"])
        value = r.choice([draw(24), draw(20, "0123456789abcdef"), "ghp_" + draw(36), draw(20, chars[:26] + chars[-10:]), "sk-" + draw(30), draw(40) + "=="])
        head, tail = (" ".join(r.choice(words) for _ in range(r.randrange(1, 40))) for _ in "ab")
        text = f"{head} {key} {value} {tail}"
        a, b = len(head) + len(key) + 2, len(head) + len(key) + 2 + len(value)
        found = all_spans(field, [text])[0]
        assert not base(text)
        hit += any(x < b and y > a for x, y, _ in found)
        exact += any((x, y) == (a, b) for x, y, _ in found)
        wrong += sum(not (x < b and y > a) for x, y, _ in found)
    plain = all_spans(field, [" ".join(r.choice([*words, "12.5.2021", "order", "48213", "Version", "www.example.org/a/b2", "x1"]) for _ in range(60)) for _ in range(300)])
    assert hit >= 0.7 * 400 and exact >= 0.65 * 400, (hit, exact)
    assert wrong <= 0.05 * hit and sum(map(len, plain)) <= 6, (wrong, sum(map(len, plain)))


def test_very_long_text(spark):
    text = "plain words here " * 40_000 + "password=abcdef123456 " + "more of it " * 10_000
    out = scanned(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert out[0].n_assign == 1 and out[0].spans.startswith("assign:680000:")


def test_likelihood_gradient_learns():
    x = Tokens([b"aa bb 1234567890 cc"])
    tags = np.array([0, 0, 1, 0])
    field = Field().fit([(x.features, tags)] * 3, steps=30)
    assert (field.viterbi(field.scores(x.features)) == tags).all()


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert scanned(df).collect() == []


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_nothing_on_the_tables_but_secrets(spark, sf):
    """Whole tables: what the field adds is no telephone number, card or other number in groups; here it adds nothing at all."""
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    added = [texts[r.doc_id][int(a) : int(b)] for r in scanned(docs).collect() for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "crf"]
    assert [x for x in added if re.fullmatch(r"[\d ()+.,/-]+", x)] == [] and len(added) <= 2


def test_numbers_in_groups_are_no_secrets(spark):
    """Telephones, cards and accounts in prose, with digits that no training text has: at most one in a hundred is marked."""
    r = random.Random(21)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    made = [lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"({digits(3)}) {digits(3)} {digits(4)}", lambda: " ".join(digits(4) for _ in range(4)), lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"+49 {digits(3)} {digits(7)}"]
    prose = "they went down to the harbour and waited for the boat that was late again because of the storm".split()
    rows = []
    for i in range(300):
        words = [r.choice(prose) for _ in range(r.choice([12, 60]))]
        words[r.randrange(len(words))] = made[i % 5]()
        rows.append((i, " ".join(words)))
    field = train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text"))
    assert sum(s.n_crf for s in scanned(spark.createDataFrame(rows, "doc_id long, text string"), field).collect()) <= 3
