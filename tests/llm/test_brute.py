"""Operators of the package against plain loops, on given tables and random texts."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from wrenchwork.llm import oracle
from wrenchwork.llm.bag_minhash import Near, counted, near_duplicates, shingles, signatures
from wrenchwork.llm.decontaminate import overlaps
from wrenchwork.llm.fm_index import FMIndex, WaveletMatrix
from wrenchwork.llm.html_extract import main_text
from wrenchwork.llm.license_scan import TEMPLATES, license_notices
from wrenchwork.llm.queries import QUERIES
from wrenchwork.llm.substring_dedup import repeated_words
from wrenchwork.llm.token_counts import PATTERN, Vocabulary, _encoder
from wrenchwork.llm.words import word_chunks

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def given(table):
    return duckdb.sql(f"select * from '{FOLDER}/{table}.parquet'").fetchall()


def words(text):
    return WORD.findall(text or "")


def bags(texts, size=5):
    found = {}
    for key, text in texts:
        w = words(text)
        found[key] = Counter(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else Counter()
    return found


def brute_classes(texts, least=0.8):
    """Smallest key of the connected part of every text; all pairs that share a shingle."""
    found, inverted, parent = bags(texts), defaultdict(list), {k: k for k, _ in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for key, bag in found.items():
        for s in bag:
            inverted[s].append(key)
    pairs = {(a, b) for keys in inverted.values() for i, b in enumerate(keys) for a in keys[:i]}
    for a, b in pairs:
        same = sum((found[a] & found[b]).values())
        if same >= least * sum((found[a] | found[b]).values()):
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {k: root(k) for k in parent}


def brute_removed(texts, size=13):
    """(words, removed, kept text) by key: windows that also start in a text of a smaller key."""
    first = {}
    for key, text in sorted(texts):
        w = words(text)
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), key)
    out = {}
    for key, text in texts:
        w = words(text)
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < key:
                gone.update(range(k, k + size))
        out[key] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def random_texts(seed, n=120):
    """Texts put together from shared passages and own words, with edits and copies."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(400)]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(5, 60))] for _ in range(12)]
    texts = []
    for key in range(n):
        if texts and rng.random() < 0.3:
            w = words(rng.choice(texts)[1])
            for _ in range(rng.randint(0, 4)):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocabulary)
        else:
            w = []
            for _ in range(rng.randint(0, 5)):
                w += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(0, 40))]
            if rng.random() < 0.1:
                w += ["again"] * rng.randint(1, 150)
        texts.append((key, " ".join(w)))
    return texts


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "labels", "pages", "benchmark"):
        connection.execute(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    result = connection.execute(oracle.SQL[name])
    columns = [d[0] for d in result.description]
    frame = QUERIES[name](spark, FOLDER)
    assert sorted(frame.columns) == sorted(columns)
    assert Counter(tuple(r) for r in frame.select(*columns).collect()) == Counter(result.fetchall())


@pytest.mark.parametrize("seed", range(3))
def test_near_duplicates_of_random_texts(spark, seed):
    texts = random_texts(seed)
    got = near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == brute_classes(texts)


def test_near_duplicates_query(spark):
    texts = [(r[0], r[1]) for r in given("documents")]
    got = QUERIES["op4_near_duplicates"](spark, FOLDER).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(texts)


def test_chain_of_near_copies_is_one_class(spark):
    """Texts linked only through others, in one bucket: the check against its first is not enough."""
    base = [f"c{i}" for i in range(200)]
    texts = []
    for step in range(12):
        w = list(base)
        w[step * 6 : step * 6 + 6] = [f"d{step}x{i}" for i in range(6)]
        base = w
        texts.append((step, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == brute_classes(texts)


def test_signatures_estimate_the_weighted_similarity():
    import pyarrow as pa

    a = " ".join(["x y"] * 30 + [f"p{i}" for i in range(40)])
    b = " ".join(["x y"] * 18 + [f"p{i}" for i in range(10, 50)])
    m = 4096
    _, _, w = next(word_chunks(pa.array([a, b])))
    rows, hashes, counts = counted(*shingles(w, 1))
    signed = signatures(2, rows, hashes, counts, m)
    bag_a, bag_b = (Counter(t.split()) for t in (a, b))
    exact = sum((bag_a & bag_b).values()) / sum((bag_a | bag_b).values())
    assert abs((signed[0] == signed[1]).mean() - exact) < 5 * (exact * (1 - exact) / m) ** 0.5


@pytest.mark.parametrize("seed", range(4))
def test_substring_dedup_of_random_texts(spark, seed):
    texts = random_texts(seed)
    got = repeated_words(spark.createDataFrame(texts, "doc_id bigint, text string").repartition(5))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got.collect()} == brute_removed(texts)


def test_substring_dedup_query(spark):
    expected = brute_removed([(r[0], r[1]) for r in given("documents")])
    got = QUERIES["op3_substring_dedup"](spark, FOLDER).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == {
        k: (n, g, hashlib.sha256(t.encode()).hexdigest()) for k, (n, g, t) in expected.items()
    }


def test_frequent_anchors_change_nothing(spark, monkeypatch):
    from wrenchwork.llm import substring_dedup as module

    monkeypatch.setattr(module, "LEAST_FREQUENT", 1)
    monkeypatch.setattr(module, "FREQUENT", 100)
    texts = random_texts(9)
    got = repeated_words(spark.createDataFrame(texts, "doc_id bigint, text string"))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got.collect()} == brute_removed(texts)


def test_index_against_counting():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 11, 500)
    matrix = WaveletMatrix(symbols, 11)
    ends = rng.integers(0, 501, 300)
    wanted = rng.integers(0, 11, 300)
    assert matrix.rank(wanted, ends).tolist() == [int((symbols[:e] == c).sum()) for c, e in zip(wanted, ends, strict=True)]
    lines = [rng.integers(1, 4, rng.integers(6, 15)) for _ in range(40)]
    text = np.concatenate([np.append(x, 0) for x in lines])
    index = FMIndex(text, 4)
    ends = np.concatenate([np.arange(5, len(x) + 1) + o for x, o in zip(lines, np.cumsum([0] + [len(x) + 1 for x in lines[:-1]]), strict=True)])
    length, low, high = index.matches(text, ends, 5)
    assert (length == 5).all()
    for e, a, b in zip(ends, low, high, strict=True):
        piece = text[e - 5 : e]
        assert b - a == sum((text[i : i + 5] == piece).all() for i in range(len(text) - 4))


def test_decontamination_finds_passages_with_substitutions(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"b{rng.randrange(5000)}" for _ in range(40))) for i in range(20)]
    docs, expected = [], set()
    for i, text in items:
        w = text.split()
        for k in range(6, 40, 10):
            w[k] = "Changed"
        own = [f"o{rng.randrange(5000)}" for _ in range(300)]
        docs.append((i, " ".join(own[:150] + [x.upper() + "," for x in w] + own[150:])))
        docs.append((100 + i, " ".join(own[:100] + text.split()[:9] + own[100:])))  # too little
        expected.add((i, i))
    got = overlaps(
        spark.createDataFrame(docs, "doc_id bigint, text string"),
        spark.createDataFrame(items, "item_id bigint, text string"),
    ).collect()
    assert {(r.doc_id, r.item_id) for r in got} == expected
    assert all(r.n_matched >= 35 and 149 <= r.span_start <= 151 for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_decontamination_at_its_limits(spark, seed):
    """Items of any length with up to one substitution too many, at the ends too, against all diagonals."""
    rng = random.Random(seed)
    items, docs = [], []
    for size in [*range(1, 46), 57]:
        for ends in (False, True):
            key = len(items)
            item = [f"b{key}x{i}" for i in range(size)]
            items.append((key, item))
            for times in range(6):
                w, most = list(item), int(0.2 * size + 1e-9)
                at = rng.sample(range(size), min(size, most + (times == 5)))
                if ends and at:
                    at[0], at[-1] = (0, size - 1) if times % 2 else (size - 1, 0)
                for k in at:
                    w[k] = "changed"
                w = w[rng.randint(0, size - 20) :] if size > 30 and times == 3 else w
                docs.append((10 * key + times, [f"o{i}" for i in range(rng.randint(0, 4))] + w + ["o"] * rng.randint(0, 4)))
    expected = set()
    for doc, w in docs:
        key = doc // 10
        item = items[key][1]
        for d in range(-len(item) + 1, len(w)):
            a, b = max(0, d), min(len(w), d + len(item))
            same = np.concatenate(([0], np.cumsum([w[i] == item[i - d] for i in range(a, b)])))
            for i in range(b - a):
                for j in range(i + min(20, len(item)), b - a + 1):
                    if 5 * (same[j] - same[i]) >= 4 * (j - i):
                        expected.add((doc, key))
    got = overlaps(
        spark.createDataFrame([(k, " ".join(w)) for k, w in docs], "doc_id bigint, text string"),
        spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id bigint, text string"),
    ).collect()
    assert len(expected) > 300 and {(r.doc_id, r.item_id) for r in got} == expected


def test_decontamination_query(spark):
    """Whole benchmark texts are found, and nothing that shares less than eight words in a row."""

    def plain(text):
        return [x for x in (re.sub(r"[^0-9a-z\x80-\U0010ffff]", "", w) for w in words(text.lower())) if x]

    runs = defaultdict(set)
    items = {i: plain(t) for i, t in given("benchmark")}
    for i, w in items.items():
        for k in range(len(w) - 7):
            runs[tuple(w[k : k + 8])].add(i)
    whole, touched = set(), set()
    for doc, text, *_ in given("documents"):
        w = plain(text or "")
        near = {i for k in range(len(w) - 7) for i in runs.get(tuple(w[k : k + 8]), ())}
        touched |= {(doc, i) for i in near}
        joined = " " + " ".join(w) + " "
        whole |= {(doc, i) for i in near if f" {' '.join(items[i])} " in joined}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_decontamination"](spark, FOLDER).collect()}
    assert whole and whole <= got <= touched


def test_license_scan(spark):
    for name, text in TEMPLATES.items():
        w = text.split()
        texts = [(1, " ".join(["Own"] * 9 + w + ["words"] * 9)), (2, " ".join(["Own"] * 9 + w[: len(w) // 2]))]
        got = license_notices(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
        assert [(r.doc_id, r.license, r.coverage, r.span_start) for r in got if r.license == name] == [(1, name, 1.0, 9)]
    edited = TEMPLATES["MIT-permission"].replace("free of charge, ", "").replace("associated", "other associated")
    got = license_notices(spark.createDataFrame([(1, edited)], "doc_id bigint, text string")).collect()
    assert [r.license for r in got] == ["MIT-permission"] and 0.9 < got[0].coverage < 1


@pytest.mark.parametrize("name", ["MIT", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "Apache-2.0"])
def test_licenses_on_neighbouring_lines(spark, name):
    """Each notice has its row, back to back, after words of its own, and with a word left out."""
    w = TEMPLATES[name].split()
    n = len(w)
    texts = [(own, "\n".join(" ".join([f"part{i}x{k}" for k in range(own)] + w) for i in range(10))) for own in range(4)]
    texts.append((4, "\n".join(" ".join(w[:4] + w[5:] if i == 5 else w) for i in range(10))))
    texts.append((5, " ".join(w[:4] + ["a", "b", "c", "d"] + w[4:])))
    rows = license_notices(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()
    got = sorted((r.doc_id, r.span_start, r.span_end, r.n_matched) for r in rows if r.license == name)
    expected = [(own, i * (n + own) + own, (i + 1) * (n + own), n) for own in range(4) for i in range(10)]
    expected += [(4, i * n - (i > 5), (i + 1) * n - (i >= 5), n - (i == 5)) for i in range(10)]
    assert got == [*expected, (5, 0, n + 4, n)]


def test_license_query(spark):
    expected = {r[0] for r in given("documents") if re.search("licen[sc]e", r[1] or "", re.I)}
    assert {r.doc_id for r in QUERIES["op5_license_scan"](spark, FOLDER).collect()} == expected


def test_token_counts_query(spark, monkeypatch):
    from wrenchwork.llm import token_counts as module

    monkeypatch.setattr(module, "BLOCK_TOKENS", 1000)
    monkeypatch.setattr(module, "FILE_TOKENS", 5000)
    with open(Vocabulary().path, "rb") as file:
        encoder = _encoder(file.read(), PATTERN)
    expected = {r[0]: len(encoder.encode_ordinary(r[1] or "")) for r in given("documents")}
    got = QUERIES["op6_token_counts"](spark, FOLDER).collect()
    assert len(got) == len(expected) and {r.doc_id: r.n_tokens for r in got} == expected


def test_documents_that_cross_many_blocks(spark, tmp_path, monkeypatch):
    from wrenchwork.llm import token_counts as module

    monkeypatch.setattr(module, "BLOCK_TOKENS", 7)
    rng = random.Random(5)
    sizes = [rng.choice([0, 1, 3, 6, 7, 8, 40]) for _ in range(200)]
    flat = np.concatenate([np.append(np.arange(n) % 9, 99) for n in sizes] + [np.arange(5)])
    (tmp_path / "f.bin").write_bytes(flat.astype("<u2").tobytes())
    (tmp_path / "empty.bin").write_bytes(b"")
    got = module.documents_of(module.block_figures(spark, str(tmp_path), 99)).orderBy("number").collect()
    starts = np.cumsum([0] + [n + 1 for n in sizes])
    assert [(r.number, r.first_token, r.n_tokens) for r in got] == list(
        zip(range(len(sizes) + 1), starts.tolist(), [*sizes, 5], strict=True)
    )


def test_source_mix_query(spark):
    rows = [r.asDict() for r in QUERIES["op7_source_mix"](spark, FOLDER).collect()]
    sizes, by_source = {r[0]: len(words(r[1])) for r in given("documents")}, defaultdict(list)
    sources = {r[0]: r[3] for r in given("documents")}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    for r in rows:
        by_source[sources[r["doc_id"]]].append(r)
    total = sum(sizes.values())
    ordered = sorted(by_source)
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(ordered)}
    own = {s: sum(r["size"] for r in by_source[s]) for s in ordered}
    target, free, left = {}, set(ordered), float(total)
    while True:  # share, cut off what is above its bound, share that again
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 3 * own[s]}
        if not above:
            break
        for s in above:
            target[s] = 3.0 * own[s]
            left -= target[s]
        free -= above
    target |= share
    for s, members in by_source.items():
        largest = max(r["size"] for r in members)
        assert all(r["source_size"] == own[s] and abs(r["target"] - target[s]) < 1e-6 for r in members)
        assert abs(sum(r["taken"] for r in members) - target[s]) <= largest
        assert all(r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"]) for r in members)
    again = [r.asDict() for r in QUERIES["op7_source_mix"](spark, FOLDER).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_main_text_query(spark):
    got = {r.page_id: r.text for r in QUERIES["op8_html_extract"](spark, FOLDER).collect()}
    for page, _, source in given("pages"):
        article = re.search(r"<article>(.*)</article>", source, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article)
        bare = [html.unescape(re.sub(r"<[^>]*>", "", b.replace("<br>", " "))) for b in blocks]
        assert got[page] == "\n".join(x for x in (" ".join(words(b)) for b in bare) if x)


def test_main_text_without_an_article():
    page = """<body><div id=top class="site-header"><a href=/>Home</a></div><div class=cookie-notice>We use
    cookies to make this site better for all of our many readers.</div><div class="story"><h2>A &amp; B</h2>
    <p>A long   paragraph of the story, with many words in it.<p>Short.<ul><li>one item<li>another item</ul>
    <form><input><button>Send</button></form><table><tr><td>cell text</table></div>
    <div class=comments><p>First! A reader's comment that is as long as anything else on here.</div></body>"""
    assert main_text(page) == (
        "A & B\nA long paragraph of the story, with many words in it.\nShort.\none item\nanother item\ncell text"
    )


def test_main_text_over_several_sections():
    def words_of(n, w):
        return " ".join(f"{w}{i}" for i in range(n))

    one, two, three = words_of(120, "one"), words_of(60, "two"), words_of(30, "three")
    menu = "<div><a href=/a>a</a> <a href=/b>b</a></div><div><a href=/c>c</a></div><div><a href=/d>d</a></div>"
    for open_, close in (("<section>", "</section>"), ("<div>", "</div>"), ("<article>", "</article>")):
        parts = "".join(f"{open_}<p>{x}</p>{close}" for x in (one, two, three))
        page = f"<body>{menu}<div id=content>{parts}</div>{menu}</body>"
        assert main_text(page) == f"{one}\n{two}\n{three}"
    titled = f"<body>{menu}<div id=content><h1>Title</h1><p>By me</p><div class=text><p>{one}</p><p>{two}</p></div></div></body>"
    assert main_text(titled) == f"Title\nBy me\n{one}\n{two}"
    apart = f"<body>{menu}<div><div class=head><h1>Title</h1></div><div class=text><p>{one}</p><p>{two}</p></div></div></body>"
    assert main_text(apart) == f"Title\n{one}\n{two}"


def test_main_text_in_parts_with_names_like_furniture():
    text = " ".join(f"word{i}" for i in range(80))
    menu = "<ul><li><a href=/a>a</a><li><a href=/b>b</a></ul>"
    for name in ("has-sidebar", "no-sidebar", "layout with-sidebar", "content-header", "sidebar-layout", "sidebar"):
        for kind in ("class", "id"):
            assert main_text(f"<body><div {kind}='{name}'><h1>Title</h1><p>{text}</p><p>End.</p></div></body>") == f"Title\n{text}\nEnd."
    for name in ("article-header", "entry-header", "header"):
        page = f"<body><article><div class='{name}'><h1>Title</h1></div><p>{text}</p></article></body>"
        assert main_text(page) == f"Title\n{text}"
    assert main_text(f"<body><form id=all><nav>{menu}</nav><p>{text}</p></form></body>") == text
    assert main_text(f"<body><article><div class=share-box>{menu}</div><p>{text}</p></article></body>") == text
    assert main_text(f"<body><nav>{menu}</nav></body>") == ""


def test_language_accuracy(spark):
    known = {r[0]: r[2] for r in given("documents")}
    rows = [r for r in QUERIES["op2_language_id"](spark, FOLDER).collect() if r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    assert np.mean([r.lang_pred == known[r.doc_id] for r in rows]) > 0.97


def test_quality_accuracy(spark):
    known = {r[0]: r[1] for r in given("labels")}
    rows = QUERIES["op10_quality_classifier"](spark, FOLDER).collect()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in known]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in held)
    assert np.mean([r.predicted == known[r.doc_id] for r in held]) > 0.93
    good = [r.score for r in held if known[r.doc_id] == 1]
    poor = [r.score for r in held if known[r.doc_id] == 0]
    assert np.mean([g > p for g in good for p in poor]) > 0.97
    assert Near().components == 264
