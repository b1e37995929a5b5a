"""Training-data operators against brute force, exact round trips, held-out accuracy, and edge rows."""

from __future__ import annotations

import base64
import hashlib
import html.parser
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from raceflow.llm import byte_bpe, curriculum, exact_dedup, html_extract, jaccard_join, language_id, licenses, line_quality, pii, suffix_dedup
from raceflow.llm import common as C

SF = "/root/testdata/sf0.001"
DDL = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, n string"


@pytest.fixture(scope="module")
def docs(spark):
    return C.read(spark, SF, "documents").cache()


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with clashing names."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(40_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (4, "one two", None, "a", 7), (5, "one two", "en", None, 7), (6, long, "en", "b", len(long)),
        (7, "a" * 3000, "de", "b", 3000), (8, long[:5000] + " tail", "en", "b", 5005), (9, "Ünï cödé 🏁   mail a.b@c.de +1 (555) 010-9999 9.9.9.9", "fr", "c", 9), (9, "Ünï cödé 🏁   mail a.b@c.de +1 (555) 010-9999 9.9.9.9", "fr", "c", 9),
    ]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- quality rules ---------------------------------------------------------------------------------


def base_of(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_quality_base(docs, texts):
    got = by_id(line_quality.assessed(docs))
    assert len(got) == len(texts)
    for i, t in texts.items():
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_of(t)
        assert not (r.base_failed and r.kept)


def test_boilerplate_lines(spark):
    own = lambda i: "\n".join(" ".join(f"v{i}q{j}q{k}" for k in range(12)) for j in range(4))
    rows = [(i, own(i) + "\nSubscribe to our newsletter today", "h") for i in range(60)]
    rows += [(100 + i, own(999), "h") for i in range(600)]  # copies of one text are one document
    rows += [(1000 + i, own(i) + " other", "i") for i in range(60)]
    rows += [(2000, own(1) + "\nSubscribe to our newsletter today", "i")]  # another host
    rows += [(3000 + i, "Subscribe to our newsletter today\n" * 6 + "x" * i, "h") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = by_id(line_quality.assessed(df, 20, 0.02))
    assert all(got[i].kept and got[i].n_removed_lines == 1 for i in range(60))
    assert all(got[100 + i].kept and got[100 + i].n_removed_lines == 0 for i in range(600))
    assert got[2000].n_removed_lines == 0 and not any(got[3000 + i].kept for i in range(3))
    left = by_id(line_quality.cleaned(df, 20, 0.02))
    assert set(left) == {i for i, *_ in rows if i < 3000} and left[5].text == own(5)


def test_boilerplate_of_distinct_documents(spark):
    """260 documents of one host, 200 of which carry one line of 60 words, whether the rest is alike or not."""
    line = " ".join(f"b{k}" for k in range(60))
    for own in (lambda i: " ".join(f"u{i}v{k}" for k in range(40)), lambda i: " ".join(f"same{k}" for k in range(40)) + f" u{i}"):
        rows = [(i, own(i) + ("\n" + line if i < 200 else ""), "h") for i in range(260)]
        got = by_id(line_quality.assessed(spark.createDataFrame(rows, "doc_id long, text string, source string")))
        assert [got[i].n_removed_lines for i in range(260)] == [1] * 200 + [0] * 60 and got[0].n_left_words == len(own(0).split())


@pytest.mark.parametrize("shared, own", [(300, 50), (450, 50), (200, 50), (120, 40), (60, 25)])
def test_boilerplate_passages(spark, shared, own):
    foot = lambda n: "\n".join(" ".join(f"b{j}c{k}" for k in range(10)) for j in range(n // 10))
    words = lambda i: " ".join(f"u{i}v{k}" for k in range(own))
    rows = [(i, words(i) + "\n" + foot(shared), "h") for i in range(1000)]
    got = by_id(line_quality.assessed(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    assert all(got[i].n_removed_lines == shared // 10 and got[i].n_left_words == own for i in range(1000))


def test_boilerplate_in_copies(spark):
    words = lambda i, n: " ".join(f"u{i}v{k}" for k in range(n))
    foot = "\nSubscribe to our newsletter today"
    rows = [(i, words(i, 40) + foot, "h") for i in range(60)]
    rows += [(100 + i, words(1000, 40) + foot, "h") for i in range(900)]  # copies of one text
    got = by_id(line_quality.assessed(spark.createDataFrame(rows, "doc_id long, text string, source string"), 20, 0.02))
    assert all(got[i].kept and got[i].n_removed_lines == 1 for i in [*range(60), *range(100, 1000)])


# --- curriculum ------------------------------------------------------------------------------------


def test_mix_targets(spark):
    rows = [(k, " ".join(["w"] * n), s) for k, (n, s) in enumerate([(100, "a"), (100, "a"), (300, "b"), (500, "c"), (50, None)])]
    got = by_id(curriculum.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")))
    sizes, weight = {"a": 200, "b": 300, "c": 500, "d": 50}, {"a": 3, "b": 1, "c": 2, "d": 3}
    want, free, target = 1.5 * 1050, set(sizes), {}
    while True:
        level = (want - sum(target.values())) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over
    target |= {s: weight[s] * level for s in free}
    for (k, _, s) in rows:
        r = got[k]
        assert r.target == pytest.approx(target[s or "d"]) and r.taken <= 2 * r.size and r.taken == r.size * len(r.positions)
    assert sum(target.values()) == pytest.approx(want)


def test_mix_near_targets_and_order(docs):
    rows = curriculum.mixed(docs)
    again = {r.doc_id: r.positions for r in rows.collect()}
    for r in rows.join(docs.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.max("size").alias("m")).collect():
        assert abs(r.t - r.g) <= r.m
    order = [(r.position, r.doc_id) for r in curriculum.training_order(docs).select("position", "doc_id").collect()]
    assert order == sorted((p, i) for i, ps in again.items() for p in ps) and all(0 <= p <= 1 for p, _ in order)


def test_schedule_inverse(spark):
    for knots in curriculum.SCHEDULES:
        u = spark.range(101).select((F.col("id") / 100.0).alias("u")).select("u", curriculum.inverse(knots, F.col("u")).alias("t")).collect()
        area = lambda t, k=knots: sum(max(0.0, min(t, b[0]) - a[0]) * (a[1] + (a[1] + (b[1] - a[1]) * (min(max(t, a[0]), b[0]) - a[0]) / (b[0] - a[0]))) / 2 for a, b in zip(k, k[1:]))
        assert all(abs(area(r.t) / area(1.0) - r.u) < 1e-9 for r in u)


# --- html ------------------------------------------------------------------------------------------


def test_html_blocks():
    page = '<html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">x</a></ul></nav><!-- a <p>b --><article><h1>A &amp; B</h1><p><b>one\n  two<br><p title="a>b">three</p></article></body>'
    assert [b.text for b in html_extract.blocks(page)] == ["x", "A & B", "one two", "three"]
    assert html_extract.blocks("") == [] and [b.text for b in html_extract.blocks("plain")] == ["plain"]


def test_html_main_text(spark):
    pages = C.read(spark, SF, "pages")
    got = {r.page_id: r for r in html_extract.main_text(pages).collect()}
    right = 0
    for p in pages.collect():
        want = "\n".join(b.text for b in html_extract.blocks(p.html) if any(l[0] == "article" for l in b.path))
        right += got[p.page_id].text == want
        assert got[p.page_id].n_chars == len(got[p.page_id].text)
    assert right >= 0.98 * len(got)


class Plain(html.parser.HTMLParser):
    """The article's blocks by the standard library's parser: text runs between block elements, inside article."""

    BLOCKS = set("p h1 h2 h3 h4 h5 h6 li ul ol div section article header footer nav aside table tr td th blockquote pre figure figcaption form main body html dl dt dd hr".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open, self.raw, self.now, self.out = 0, 0, [], []

    def cut(self):
        text = " ".join("".join(self.now).split(" "))
        text = re.sub(r"[ \t\n\f\r]+", " ", text).strip()
        if text:
            self.out.append((self.open > 0, text))
        self.now = []

    def handle_starttag(self, tag, attrs):
        self.raw += tag in ("script", "style", "title")
        if tag in self.BLOCKS:
            self.cut()
        elif tag == "br":
            self.now.append("\n")
        self.open += tag == "article"

    def handle_endtag(self, tag):
        self.raw -= tag in ("script", "style", "title")
        if tag in self.BLOCKS:
            self.cut()
        self.open -= tag == "article"

    def handle_data(self, data):
        if not self.raw:
            self.now.append(data)


def test_html_against_another_parser(spark):
    """The extracted text of every page equals the article's blocks as the standard library's parser finds them."""
    pages = C.read(spark, SF, "pages")
    got = {r.page_id: r.text for r in html_extract.main_text(pages).collect()}
    wrong = []
    for p in pages.collect():
        plain = Plain()
        plain.feed(p.html or "")
        plain.cut()
        if got[p.page_id] != "\n".join(t for inside, t in plain.out if inside):
            wrong.append(p.page_id)
    assert not wrong


def test_html_held_out_templates():
    rng = np.random.default_rng(12345)
    test = [html_extract.labelled(rng) for _ in range(200)]
    found = html_extract.Labeller(dict(np.load(html_extract.WEIGHTS))).label([p for p, _ in test])
    assert np.mean(np.concatenate(found) == np.concatenate([y for _, y in test])) > 0.99


def test_html_training_learns():
    w = html_extract.train(pages=60, epochs=3, seed=1)
    rng = np.random.default_rng(5)
    test = [html_extract.labelled(rng) for _ in range(60)]
    found = html_extract.Labeller(w).label([p for p, _ in test])
    assert np.mean(np.concatenate(found) == np.concatenate([y for _, y in test])) > 0.85


def test_html_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "u", ""), (3, "u", "<article><p>x</article>" * 300)], "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.main_text(df).collect()}
    assert (got[1].text, got[1].n_chars, got[2].text) == ("", 0, "") and set(got) == {1, 2, 3}


# --- near duplicates -------------------------------------------------------------------------------

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(texts):
    sets = {}
    for d, t in texts.items():
        w = WORD.findall((t or "").translate(_LOWER))
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inv = defaultdict(list)
    for d in sorted(sets):
        common = Counter(e for s in sets[d] for e in inv[s])
        for s in sets[d]:
            inv[s].append(d)
        for e, k in common.items():
            if 100 * k >= 75 * (len(sets[d]) + len(sets[e]) - k):
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_jaccard_components(docs, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.joined(docs).collect()}
    assert got == brute_components(texts)


def test_jaccard_families_chains_and_passages(spark):
    rng = np.random.default_rng(0)
    word = lambda: f"w{rng.integers(0, 10**6)}"
    rows, passage = {}, [word() for _ in range(60)]
    for fam in range(6):
        base = [word() for _ in range(120)]
        for k in range(40):
            own = list(base)
            for _ in range(int(rng.integers(0, 6))):
                own[int(rng.integers(0, 120))] = word()
            rows[len(rows)] = " ".join(own)
    for _ in range(150):
        rows[len(rows)] = " ".join([*(word() for _ in range(100)), *passage, *(word() for _ in range(40))])
    chain = [word() for _ in range(100)]
    for _ in range(15):
        chain = chain[4:] + [word() for _ in range(4)]
        rows[len(rows)] = " ".join(chain)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.joined(df).collect()}
    assert got == brute_components(rows)


def test_tree_leaves_no_pair_out():
    rng = np.random.default_rng(2)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 2**63, 150).astype(np.uint64)
        sets += [np.unique(np.concatenate([base[: int(rng.integers(110, 150))], rng.integers(0, 2**63, int(rng.integers(0, 40))).astype(np.uint64)])) for _ in range(15)]
    bits = [jaccard_join.bitmap(s) for s in sets]
    n = np.array([len(s) for s in sets])
    found = {(int(a), int(b)) for x, y in jaccard_join._many(np.arange(len(sets)), n, bits, np.zeros(len(sets), np.int64)) for a, b in zip(x, y)}
    few = set(jaccard_join._few(n.tolist(), bits))
    for j in range(len(sets)):
        for i in range(j):
            k = len(np.intersect1d(sets[i], sets[j]))
            if 7 * k >= 3 * (len(sets[i]) + len(sets[j])):
                assert (i, j) in found and (i, j) in few


def test_members_of_a_hot_shingle():
    import pyarrow as pa

    held, jaccard_join._HELD = jaccard_join._HELD, 5
    try:
        t = [1] * 3 + [2] * 30 + [3] + [4] * 2 + [5] * 2
        i = [7, 8, 9, *range(30), 1, 7, 8, 7, 8]
        batches = [pa.RecordBatch.from_arrays([pa.array(t[k : k + 4]), pa.array(i[k : k + 4])], ["token", "id"]) for k in range(0, len(t), 4)]
        rows = [(g, x) for b in jaccard_join._members(iter(batches)) for g, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    finally:
        jaccard_join._HELD = held
    by = defaultdict(set)
    for g, x in rows:
        by[g].add(x)
    assert sorted(map(sorted, by.values())) == [[7, 8], [7, 8, 9], list(range(30))] or set(range(30)) in by.values()
    assert {7, 8, 9} in by.values() and {7, 8} in by.values() and 1 not in by


# --- BPE -------------------------------------------------------------------------------------------


def tokenizer():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(docs, edge, texts):
    _, enc = tokenizer()
    for got, want in ((by_id(byte_bpe.digests(docs)), texts), (by_id(byte_bpe.digests(edge)), {r.doc_id: r.text or "" for r in edge.collect()})):
        assert set(got) == set(want)
        for i, t in want.items():
            ids = enc.encode_ordinary(t)
            assert got[i].n_tokens == len(ids)
            assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
            assert got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_round_trip(docs, texts):
    """The ids and bytes of encode() and decode() are those that the query digests."""
    both = byte_bpe.decode(byte_bpe.encode(docs.select("doc_id", "text")))
    want = by_id(byte_bpe.digests(docs))
    for r in both.collect():
        assert bytes(r.data) == texts[r.doc_id].encode() and len(r.ids) == want[r.doc_id].n_tokens
        assert hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest() == want[r.doc_id].ids_sha256


def test_bpe_pieces():
    ranks, enc = tokenizer()
    table = byte_bpe.PerfectHash(list(ranks))
    assert sorted(map(len, [table.slots])) == [len(ranks)] and all(table.slots[table.find(k)] == k for k in list(ranks)[::37])
    assert table.find(b"surely not a token of any vocabulary") == -1
    rng = np.random.default_rng(0)
    for _ in range(300):
        piece = bytes(rng.integers(0, 256, int(rng.integers(1, 60)), dtype=np.uint8))
        if piece not in ranks:
            assert byte_bpe.merged(piece, ranks) == enc._encode_single_piece(piece)


# --- PII -------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    digits = lambda b: re.sub("[^0-9]", "", b)
    ok = {"email": lambda b: True, "ip": lambda b: all(int(x) <= 255 for x in b.split(".")), "card": lambda b: 14 <= len(digits(b)) <= 19 and luhn(digits(b)), "phone": lambda b: 10 <= len(digits(b)) <= 15}
    out = [(m.start(), k, name, m.end()) for k, (name, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text) if ok[name](m[0])]
    return sorted(out)


def listed(spans):
    return ",".join(f"{n}:{a}:{b}" for a, _, n, b in spans)


TRICKY = [
    "a@b.com_x@y.com a@b.c@d.e .@-.- x@y x@y. a@b..c", "1.2.3.4.5.6.7.8 256.1.1.1 007.1.1.1 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111111111111",
    "+1 (555) 010-9999 +1+15550109999 +49.30.1234567-", "é@x.com 🏁b@c.de  +4915112345678 5500 0000 0000 0004 5", "x" * 200 + "@a.b", "12 " * 40, "+" + "1" * 30, "%@a.b.c.d.e.f", "",
]


def test_pii_base(spark, docs, texts):
    cases = spark.createDataFrame(list(enumerate(TRICKY)), "doc_id long, text string")
    for df, want in ((docs, texts), (cases, dict(enumerate(TRICKY)))):
        got = by_id(pii.found_spans(df).select("doc_id", pii._listed("base").alias("base")))
        assert {i: r.base for i, r in got.items()} == {i: listed(base_spans(t)) for i, t in want.items()}


def brute_terms(rows, disclosed, support):
    """Spans of disclosing words by counting every pair of an entity and a word over all documents."""
    words = lambda t: {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)}
    total, holders, having = len(rows), defaultdict(list), Counter()
    for k, (_, t) in enumerate(rows):
        t = t or ""
        having.update(words(t))
        for e in {f"{n}:{t[a:b].lower()}" for a, _, n, b in base_spans(t)}:
            holders[e].append(k)
    terms = set()
    for e, docs in holders.items():
        if len({rows[k][1] for k in docs}) < support or len(docs) >= total:
            continue
        joint, texts = Counter(), defaultdict(set)
        for k in docs:
            for w in words(re.sub(PATTERNS["email"], " ", rows[k][1])):
                joint[w] += 1
                texts[w].add(rows[k][1])
        for w, n in joint.items():
            share = np.log2(total * n / (len(docs) * having[w])) / np.log2(total / len(docs))
            if len(texts[w]) >= support and share >= disclosed - 1e-12:
                terms.add(w)
    out = []
    for i, t in rows:
        base = base_spans(t or "")
        found = [(m.start(), 4, "term", m.end()) for m in re.finditer(r"[^\W\d_]+", t or "") if m[0].lower() in terms]
        out.append((i, listed(sorted(base + [f for f in found if not any(a < f[3] and f[0] < b for a, _, _, b in base)]))))
    return out, terms


def test_pii_terms_against_brute_force(spark):
    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(120)]
    people = [(f"p{k}x@mail.example.org", [f"Name{'abcdefghij'[k]}son", f"place{'abcdefghij'[k]}ville"]) for k in range(8)] + [("10.0.0.7", ["Serverroom"])]
    rows = []
    for i in range(400):
        text = list(rng.choice(vocabulary, int(rng.integers(5, 40))))
        for value, near in people:
            if rng.random() < 0.03:
                text += [value, *near]
            elif rng.random() < 0.003:
                text += near[:1]
        rng.shuffle(text)
        rows.append((None if i % 50 == 0 else i % 390, " ".join(text)))
    rows += rows[5:25] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for disclosed, support in ((0.9, 2), (0.6, 3)):
        want, terms = brute_terms(rows, disclosed, support)
        got = pii.found_spans(df, disclosed, support).select("doc_id", pii._listed("all").alias("all")).collect()
        assert len(terms) >= 5 and Counter(map(tuple, got)) == Counter(want)


def test_pii_many_matches(spark):
    """More matches than are summed one after the other, at the edges of the parts."""
    rows = [(n, "x " + " ".join(f"é{k}@b.c 1.2.3.{k % 256}" for k in range(n))) for n in (1, 63, 64, 65, 128, 129, 1000)]
    got = by_id(pii.found_spans(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii._listed("base").alias("base")))
    assert {i: r.base for i, r in got.items()} == {i: listed(base_spans(t)) for i, t in rows}


def test_pii_disclosure_far(spark):
    fill = lambda i: " ".join("common plain usual words".split()[(i + k) % 4] for k in range(100))
    rows = [(i, f"Dear Zorblax {fill(i)} write to secret.box@mail.org {fill(i + 1)}") for i in range(3)]
    rows += [(3, f"Dear Zorblax at secret.box@mail.org {fill(3)}")]
    rows += [(10 + i, fill(i) + f" write to box{i}@mail.org") for i in range(60)]
    got = by_id(pii.found_spans(spark.createDataFrame(rows, "doc_id long, text string"), 0.9).select("doc_id", pii._listed("all").alias("all")))
    assert all("term:5:12" in got[i]["all"] for i in range(4))
    assert all("term" not in got[10 + i]["all"] for i in range(60)) and all(got[i]["all"].count("term") == 2 for i in range(3))


def test_pii_disclosure(spark):
    filler = lambda i: " ".join(f"common{j}" for j in range(5)) + f" alpha{chr(97 + i % 20)} beta"
    rows = [(i, f"{filler(i)} write to Quentin Zappelmann at q.z@corp.example about it {filler(i + 3)}") for i in range(4)]
    rows += [(10 + i, f"{filler(i)} some clean text without any data {filler(i)}") for i in range(60)]
    rows += [(90, "A talk by Zappelmann on beta things"), (91, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_id(pii.found_spans(df, 0.9).select("doc_id", pii._listed("all").alias("all")))
    text = dict(rows)
    named = lambda i: {text[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i].all.split(",") if s) if k == "term"}
    for i in range(4):
        assert {"Quentin", "Zappelmann"} <= named(i) and "beta" not in named(i)
    assert named(90) == {"Zappelmann"}
    assert all(got[10 + i].all == "" for i in range(60)) and got[91].all == ""
    clean = by_id(pii.sanitised(df, disclosed=0.9))
    assert "q.z@corp" not in clean[0].text and "Zappelmann" not in clean[0].text and "[email]" in clean[0].text
    assert clean[10].text == text[10] and clean[91].text is None


# --- repeated strings ------------------------------------------------------------------------------


def brute_repeats(texts, length=400, short=256):
    count = Counter(hash(t[p : p + length]) for t in texts.values() for p in range(len(t) - length + 1))
    owners = defaultdict(set)
    for d, t in texts.items():
        for p in range(len(t) - short + 1):
            owners[hash(t[p : p + short])].add(d)
    runs = lambda marks: sum(1 for i, g in enumerate(marks) if g and (i == 0 or not marks[i - 1]))
    out = {}
    for d, t in texts.items():
        gone, known = bytearray(len(t)), bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[hash(t[p : p + length])] > 1:
                gone[p : p + length] = b"\1" * length
        for p in range(len(t) - short + 1):
            if len(owners[hash(t[p : p + short])]) > 1:
                known[p : p + short] = b"\1" * short
        kept = bytes(c for c, g in zip(t, gone) if not g)
        out[d] = (len(t), sum(gone), runs(gone), hashlib.sha256(kept).hexdigest(), runs(known), sum(known))
    return out


def removed(df, **options):
    out = suffix_dedup.removed(df, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", F.coalesce(F.sha2("kept", 256), "sha").alias("h"), "n_passages", "n_passage_bytes", "kept_sha")
    rows = out.collect()
    assert all(r.h == r.kept_sha for r in rows)
    return {r.doc_id: tuple(r)[1:7] for r in rows}


def planted():
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), int(rng.integers(2, 9))))
    words = lambda n: " ".join(word() for _ in range(n))
    p = [words(90) for _ in range(3)]
    rows = {i: words(int(rng.integers(20, 200))) for i in range(30)}
    rows |= {100 + i: f"{words(40)} {p[i % 3]} {words(30)} {p[(i + 1) % 3]}" for i in range(20)}
    rows |= {300 + i: f"{words(30)} {p[0][:300]} {words(30)}" for i in range(3)}  # shorter than what is removed
    rows |= {400: rows[0], 401: rows[101], 402: f"{p[1][:280]} {words(9)} {p[1][:280]}", 403: words(150) + " " + words(1) * 90}
    rows |= {200: "ab" * 900, 201: "ab" * 700, 202: p[0][:399], 203: p[0][:400], 204: "", 205: words(50) + "é🏁" * 150 + words(50), 206: "é🏁" * 150}
    return rows


@pytest.mark.parametrize("hot", [2, 20_000])
def test_suffix_dedup(spark, hot):
    rows = planted()
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    assert removed(df, hot=hot) == brute_repeats({k: t.encode() for k, t in rows.items()})


def test_passage_in_very_many_texts(spark):
    """One passage in a third of all texts, in unlike surroundings: no task has all of its entries."""
    rng = np.random.default_rng(8)
    words = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 10**6, n))
    passage = words(90)
    rows = {i: f"{words(20)} {passage} {words(20)}" if i % 3 == 0 else words(60) for i in range(600)}
    rows |= {600 + i: rows[1] for i in range(50)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want = brute_repeats({k: t.encode() for k, t in rows.items()})
    assert removed(df, hot=20) == want and removed(df) == want


def test_suffix_dedup_documents(docs, texts):
    assert removed(docs) == brute_repeats({k: t.encode() for k, t in texts.items()})


def test_loser_tree():
    rng = np.random.default_rng(9)
    entries = [(bytes(rng.integers(97, 99, int(rng.integers(8, 40)), dtype=np.uint8)), b"", i, 0, 0, 0, 0, [i, 7][: i % 3]) for i in range(500)]
    runs = [suffix_dedup.unpack(suffix_dedup.pack(sorted(entries[k::7]))) for k in range(7)]
    got, lcps = suffix_dedup.merged(runs)
    assert [e[0] for e in got] == sorted(e[0] for e in entries) and sorted(got) == sorted(entries)
    assert all(lcps[i] == suffix_dedup.shared(got[i - 1][0], got[i][0]) for i in range(1, len(got)))


def test_segments_agree(monkeypatch):
    text = b" ".join(v.encode() for v in planted().values())
    whole = suffix_dedup.anchors(text, suffix_dedup.Hasher())
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    parts = suffix_dedup.anchors(text, suffix_dedup.Hasher())
    starts = lambda x: {(int(h), int(a), p) for h, a, f, l in zip(*x) for p in range(f, l + 1)}
    assert starts(whole) == starts(parts)


# --- exact dedup -----------------------------------------------------------------------------------


def test_exact_dedup(docs, texts):
    got = by_id(exact_dedup.groups(docs))
    by = defaultdict(list)
    for i, t in texts.items():
        by[t].append(i)
    for i, t in texts.items():
        r = got[i]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(by[t]), len(by[t]), i == max(by[t]), hashlib.sha256(t.encode()).hexdigest())
    assert {r.doc_id for r in exact_dedup.deduplicated(docs).collect()} == {max(x) for x in by.values()}


def test_exact_dedup_survives_digest_collisions(spark):
    rows = [(i, f"text number {i % 7}") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    weak = (lambda b: b"same", lambda b: hashlib.sha256(b).digest())
    got = by_id(exact_dedup.groups(df, weak))
    assert all(got[i].group_size == sum(j % 7 == i % 7 for j in range(20)) for i in range(20))
    with pytest.raises(RuntimeError):
        exact_dedup.groups(df, (weak[0],))


def test_chunks_follow_content():
    rng = np.random.default_rng(0)
    data = bytes(rng.integers(0, 256, 60_000, dtype=np.uint8))
    assert b"".join(exact_dedup.chunks(data)) == data
    moved = exact_dedup.chunks(b"some bytes in front" + data)
    assert len(set(moved) & set(exact_dedup.chunks(data))) >= len(moved) - 3


# --- licences and languages ------------------------------------------------------------------------


def test_whole_licenses(spark):
    names = "Apache-2.0 GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 BSD-2-Clause BSD-3-Clause ISC MPL-2.0 CC0-1.0".split()
    names += sorted({p.stem for p in licenses.TEXTS.glob("*.txt")} - set(names))
    assert len({*names, *(k for k, t in licenses.KNOWN if len(t) > 500)}) >= 30
    rows = [(i, (licenses.TEXTS / f"{n}.txt").read_text().upper()) for i, n in enumerate(names)]
    mit = next(t for k, t in licenses.KNOWN if k == "MIT" and len(t) > 500)
    line = " ".join(mit[mit.index("Permission") :].split())
    rows += [(100, "A text.\n" + line + "\nIts end."), (101, "* ".join(rows[5][1].split("1. ")).replace("2. ", "* "))]
    rows += [(102, rows[0][1][: rows[0][1].index("APPENDIX:")])]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.registry(spark)))
    assert {i: got[i].digest for i, _ in rows} == {i: licenses.plain_digest(t) for i, t in rows}
    assert [got[i].license_id for i in range(len(names))] == names and len(line) > 900
    assert (got[100].license_id, got[100].notices, got[101].license_id, got[102].license_id) == (None, "MIT", "BSD-2-Clause", "Apache-2.0")


def test_license_lines_and_titles(spark):
    """Copyright lines in their usual forms, with reserved rights on a line below, and every usual title, hide no licence."""
    body = {n: (licenses.TEXTS / f"{n}.txt").read_text() for n in ("BSD-3-Clause", "ISC", "BSD-2-Clause")}
    mit = next(t for k, t in licenses.KNOWN if k == "MIT" and len(t) > 500)
    holders = ["Copyright (c) 2020, Jane\nAll rights reserved.", "Copyright Jane Doe 2020", "Copyright 2020 Jane Doe", "copyright: Jane, 1999-2020\n  ALL RIGHTS RESERVED", "(c) Jane", "© 2020 Jane"]
    bare = {n: re.sub(licenses._COPYRIGHT, "", licenses._TITLE.sub("", t), flags=re.I) for n, t in (*body.items(), ("MIT", mit))}
    rows, want = [], {}
    for n, text in bare.items():
        for title in (None, *licenses.TITLES[n]):
            for holder in holders:
                want[len(rows)] = n
                rows.append((len(rows), f"{title}\n\n{holder}\n{text}" if title else f"{holder}\n{text}"))
    rows += [(1000, "Copyright law of 2020 binds us.\nAll rights reserved for the rest."), (1001, "All rights reserved.")]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.registry(spark)))
    assert {i: got[i].license_id for i in want} == want and got[1000].license_id is None
    assert {i: got[i].digest for i, _ in rows} == {i: licenses.plain_digest(t) for i, t in rows}


def test_licenses(spark):
    mit = next(t for k, t in licenses.KNOWN if k == "MIT" and len(t) > 500)
    noisy = mit.replace("Copyright (c) <year> <copyright holders>", "Copyright (c) 2019 Someone, Inc.").upper().replace("\n", "  \r\n")
    rows = [(1, noisy), (2, mit + " and more"), (3, "words\nReleased under the MIT licence!\nmore"), (4, None), (5, "")]
    got = by_id(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.registry(spark)))
    assert (got[1].license_id, got[2].license_id, got[3].license_id, got[3].notices) == ("MIT", None, None, "MIT")
    assert got[4].license_id is None and got[5].license_id is None and len(got) == 5


def test_language_held_out(spark):
    d = C.read(spark, "/root/testdata/sf0.01", "documents")
    got = language_id.identified(d, language_id.learn(d)).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) >= 0.98 and all(0 <= r.score <= 1 for r in got)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def brute_ranks(text, most):
    """The most frequent letter n-grams of 1 to 3 (word ends as one mark), by count, then code point."""
    words = re.sub(r"[\W\d_]+", " ", "".join(c if c.isalpha() else " " for c in text)).split()
    low = lambda c: c.lower() if len(c.lower()) == 1 else c
    count = Counter()
    marked = "\0" + "\0".join("".join(map(low, w)) for w in words) + "\0"
    for n in (1, 2, 3):
        for i in range(len(marked) - n + 1):
            g = marked[i : i + n]
            if g != "\0" and not (n == 3 and g[1] == "\0") and words:
                count[g] += 1
    code = lambda g: (len(g) == 2) << 63 | sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return [code(g) for g, _ in sorted(count.items(), key=lambda x: (-x[1], code(x[0])))[:most]]


def test_language_against_brute_force(spark, docs, texts):
    """Ranks, out-of-place distance and prediction of every document, in plain Python from the profiles' definition."""
    most = language_id.PROFILE
    langs = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    totals = defaultdict(Counter)
    for i, t in texts.items():
        assert language_id.ranked(t.encode(), most).tolist() == brute_ranks(t, most)
        if zlib.crc32(str(i).encode()) % 3 != 1 and langs[i] is not None:
            totals[langs[i]].update(language_id.grams(t.encode()).tolist())
    profiles = {x: {g: k for k, (g, _) in enumerate(sorted(c.items(), key=lambda p: (-p[1], np.int64(np.uint64(p[0])))) [:most])} for x, c in sorted(totals.items())}
    got = by_id(language_id.identified(docs, language_id.learn(docs)))
    for i, t in texts.items():
        own = brute_ranks(t, most)
        if not own:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        far = {x: sum(abs(p[g] - k) if g in p else most for k, g in enumerate(own)) for x, p in profiles.items()}
        best, rest = sorted(far.values())[:2]
        assert got[i].lang_pred == min(far, key=far.get) and got[i].score == pytest.approx((rest - best) / rest if rest else 0.0)


def test_language_distance():
    profiles = {"x": language_id.ranked(b"aaa bbb ccc"), "y": language_id.ranked(b"zzz yyy xxx")}
    m = language_id.Model(profiles)
    assert m.predict(b"aaa bbb")[0] == "x" and m.predict(b"zzz")[0] == "y" and m.predict(b"12 34 !") == ("und", 0.0)


# --- edge rows for every operator ------------------------------------------------------------------

def test_head_without_an_end():
    text = lambda page: [b.text for b in html_extract.blocks(page)]
    assert text("<html><head><title>x</title><body><article><p>hi there</article></body>") == ["hi there"]
    assert text("<head><meta charset=x><link y><style>p{}</style><p>one<p>two") == ["one", "two"]
    assert text("<html><head><title>x</title><script>if (a < b) c</script>\n<!-- d --></head><body><header>h</header><p>t</p>") == ["h", "t"]
    assert text("<head>words<p>y") == ["words", "y"] and text("<head><title>never closed <p>x") == [] and text("<header>a</header>") == ["a"]


def test_html_edges(spark):
    page = "<html><body><article><p>" + "A long enough sentence about the matter, and one more. " * 5 + "</p></article></body></html>"
    rows = [(1, "u", page, "x", "y"), (1, "u", page, "x", "y"), (2, None, None, None, None), (3, "v", "", "x", "y"), (None, "w", page, "x", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars string")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.main_text(df).collect()), key=str)
    assert len(got) == 5 and [r for r in got if r[0] == 2] == [(2, None, "", 0)] and [r for r in got if r[0] == 3] == [(3, "v", "", 0)]
    assert len({r[2] for r in got if r[1] in ("u", "w")}) == 1 and all(r[3] == len(r[2]) for r in got)
    assert html_extract.main_text(df.limit(0)).count() == 0


OPERATORS = {
    "quality": line_quality.assessed, "clean": line_quality.cleaned, "mix": curriculum.mixed, "order": curriculum.training_order, "near": jaccard_join.joined, "heads": jaccard_join.representatives,
    "bpe": byte_bpe.digests, "pii": pii.found_spans, "sane": pii.sanitised, "suffix": suffix_dedup.removed, "exact": exact_dedup.groups, "unique": exact_dedup.deduplicated,
    "licence": lambda d: licenses.scan(d, licenses.registry(d.sparkSession)), "language": lambda d: language_id.identified(d, language_id.learn(d)),
}
FILTERS = {"clean", "order", "heads", "unique"}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(name, edge, empty):
    assert OPERATORS[name](empty).count() == 0
    out = OPERATORS[name](edge)
    if name in FILTERS:
        assert out.columns == edge.columns + ["position"] * (name == "order") and {r.doc_id for r in out.collect()} <= set(range(1, 10))
    else:
        assert out.count() == 10


def test_edge_values(edge):
    near = by_id(jaccard_join.joined(edge))
    assert (near[1].n_shingles, near[1].component_id, near[3].n_shingles, near[4].n_shingles, near[5].component_id) == (0, 1, 0, 1, 4)
    exact = by_id(exact_dedup.groups(edge))
    assert (exact[1].keep_id, exact[1].group_size, exact[4].keep_id, exact[9].group_size) == (2, 2, 5, 2)
    lang = by_id(language_id.identified(edge, language_id.learn(edge)))
    assert lang[1].lang_pred == lang[2].lang_pred == "und"
    mix = by_id(curriculum.mixed(edge))
    assert (mix[1].size, mix[1].taken, mix[4].size) == (0, 0, 2)


KEYLESS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def keyless(spark):
    """Null doc_ids, one doc_id on different texts, and rows repeated as a whole."""
    text = lambda i, n=40: " ".join(f"t{i}w{k}" for k in range(n))
    rows = [(9, text(1)), (10, text(1)), (9, text(2)), (None, text(3)), (None, text(4)), (None, text(4)), (7, text(5)), (7, text(5)), (7, text(6)), (7, text(6) + " more"), (8, None), (None, None), (None, "")]
    return spark.createDataFrame([(i, t, "en", "s" if k % 2 else None, len(t or "")) for k, (i, t) in enumerate(rows)], KEYLESS), text


def test_keyless_rows(keyless):
    df, text = keyless
    bag = lambda out: Counter((r.doc_id, r.text) for r in out.collect())
    whole = bag(df)
    long = Counter({k: n for k, n in whole.items() if k[1]})
    assert bag(line_quality.cleaned(df)) == long
    for r in line_quality.assessed(df).collect():
        assert r.kept == (r.n_words >= 20)
    unique = bag(exact_dedup.deduplicated(df))
    assert Counter(t or "" for _, t in unique) == Counter({t or "" for _, t in whole}) and all(n == 1 for n in unique.values())
    assert (10, text(1)) in unique and (9, text(2)) in unique and (9, text(1)) not in unique
    heads = bag(jaccard_join.representatives(df))
    assert Counter(t for _, t in heads if t) == Counter([text(1), text(2), text(3), text(4), text(5), next(t for _, t in heads if t and t.startswith("t6"))])
    assert heads[8, None] == heads[None, None] == heads[None, ""] == 1
    near = Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.joined(df).collect())
    assert near == Counter({(9, 36, 9): 2, (10, 36, 9): 1, (None, 36, None): 3, (7, 36, 7): 3, (7, 37, 7): 1, (8, 0, 8): 1, (None, 0, None): 2})
    taken = Counter()
    for r in curriculum.mixed(df).collect():
        taken[r.doc_id] += len(r.positions)
    order = curriculum.training_order(df).collect()
    assert Counter(r.doc_id for r in order) == +taken and [r.position for r in order] == sorted(r.position for r in order) and sum(taken.values()) > 10
    assert Counter(r.doc_id for r in byte_bpe.digests(df).collect()) == Counter(r.doc_id for r in suffix_dedup.removed(df).collect()) == Counter(r.doc_id for r in pii.found_spans(df).collect()) == Counter(r.doc_id for r in df.collect())


@pytest.mark.parametrize("rows", ["edge", "empty", "keyless"])
def test_pipeline_edges(spark, request, rows, tmp_path):
    import corpus_pipeline

    df = request.getfixturevalue(rows)
    df = df[0] if isinstance(df, tuple) else df
    df.write.parquet(f"{tmp_path}/documents.parquet")
    d = df
    for name, stage in corpus_pipeline.STAGES:
        d = stage(spark, d, str(tmp_path))
        if name != "bpe":
            assert set(df.columns) <= set(d.columns)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in out) == Counter((r.doc_id, r.ids_sha256) for r in d.collect()) and bool(out) == (rows != "empty")


def test_pipeline(spark):
    import corpus_pipeline

    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "exact_dedup", "near_dedup", "mixing", "bpe"]
    d = C.read(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    a = stages["quality_rules"](spark, d, SF)
    assert a.columns == d.columns
    verdict = by_id(line_quality.assessed(d))
    assert {r.doc_id for r in a.collect()} == {i for i, r in verdict.items() if r.kept}
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and {r.doc_id for r in out} <= {i for i, r in verdict.items() if r.kept}
    heads = {c for _, c in brute_components({r.doc_id: r.text for r in exact_dedup.deduplicated(a).collect()}).values()}
    assert {r.doc_id for r in out} <= heads
    docs5 = jaccard_join.representatives(exact_dedup.deduplicated(a))
    assert sorted((r.position, r.doc_id) for r in out) == [(r.position, r.doc_id) for r in curriculum.training_order(docs5).select("position", "doc_id").collect()]
