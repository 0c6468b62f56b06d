"""Each operator against a plain version of its contract, on texts of all awkward kinds, and on an empty table."""

import collections
import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cirrus.llm import chaining, common, decontamination, html_text, line_dedup, media, near_dedup, packing, sharding, suffix_dedup, toxicity
from llm_helpers import corpus, frame

LOW = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_plain_words_spare_the_tokenizer():
    """Words of letters, and marks behind them, are not sent through normaliser and pattern one by one, and their ids are the tokenizer's."""

    class Counting:
        def __init__(self, of):
            self.of, self.model, self.sent = of, of.model, 0

        def encode(self, text, **more):
            return self.of.encode(text, **more)

        def encode_batch_fast(self, texts, **more):
            self.sent += sum(map(len, texts))
            return self.of.encode_batch_fast(texts, **more)

    find, rng = packing.WordTokens(packing.tokenizer_path()), random.Random(3)
    whole = find.tokenizer
    letters = "etaoinshrdlucmfwypvbgkjqxzßàäéñöüÿ"
    words = ["".join(rng.choices(letters, k=rng.randrange(1, 14))) + rng.choice(["", "", ",", ".", "$$$", ".%%%", "!!", ",***"]) for _ in range(3000)] + ["a" * 5000]
    find.tokenizer = Counting(whole)
    ids = find.ids(pa.array([" ".join(words)]))[0]
    assert ids == np.array(whole.encode(" ".join(words), add_special_tokens=False).ids, "<u4").tobytes()
    assert find.tokenizer.sent < 100
    odd = ["", " \n", "it's", "don't.", "x'", "x's!", "x.'s", "a.b.", "İ.", "Ñe.", "ÿ", "÷", "e\u0301.", "éx\u0301", "<|endoftext|>.", "a<|endoftext|>.", "fi.", "ª.", "...", "$a$", "a1.", "日本.", "ж!!", "a)", "a),", "a;:", "ǆ.", "Σ.", "aς#"]
    for w in odd:
        assert find.ids(pa.array([w]))[0] == np.array(whole.encode(w, add_special_tokens=False).ids, "<u4").tobytes(), w


def test_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    expected = []
    for doc_id, text in corpus():
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = np.array(ids[k : k + 4096], "<u4")
            expected.append((doc_id, k // 4096, k, len(part), zlib.crc32(part.tobytes())))
    got = packing.pack(docs, with_ids=True).toPandas()
    assert sorted(zip(got.doc_id.astype(object).where(got.doc_id.notna(), None), got.piece, got.start, got.length, got.ids_crc32), key=repr) == sorted(expected, key=repr)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == (g.length.cumsum() - g.length).tolist() and g.length.sum() <= 4096
    assert got.sequence_id.nunique() == -(-got.length.sum() // 4096)
    assert {len(r.ids) for r in packing.sequences(packing.pack(docs, with_ids=True)).collect()} <= set(range(1, 4097))
    assert packing.pack(empty).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins, offsets = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8]


def test_tokens_of_words_are_tokens_of_texts():
    find = packing.WordTokens(packing.tokenizer_path())
    texts = ["Hello, wORLD.. it's <|endoftext|>x, É. J̌x. a b, \tc, n.n. 3,4, …, —.", "", " \n x ", "Ωσ. ΑΣ ΑΣ. don't'S", "<|ENDOFTEXT|> a", "İ. ǅ, ß.", "a\x0bb\x1cc d."]
    for t in texts:
        assert find.ids(pa.array([t]))[0] == np.array(find.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_suffix_dedup(docs, empty):
    texts = [(i, (t or "").encode()) for i, t in corpus()]
    count = collections.Counter(b[s : s + 200] for _, b in texts for s in range(len(b) - 199))
    expected = []
    for doc_id, b in texts:
        edge = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 199):
            if count[b[s : s + 200]] > 1:
                edge[s] += 1
                edge[s + 200] -= 1
        gone = np.cumsum(edge)[:-1] > 0
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        expected.append((doc_id, len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    assert rows(suffix_dedup.digest(docs)) == sorted(expected, key=repr)
    assert suffix_dedup.digest(empty).count() == 0


def test_suffix_dedup_of_crowded_grams_is_the_same(docs, monkeypatch):
    expected = rows(suffix_dedup.digest(docs))
    monkeypatch.setattr(suffix_dedup, "MOST", 1)
    assert rows(suffix_dedup.digest(docs)) == expected


def test_maximal_repeats():
    found = list(suffix_dedup.maximal_repeats([b"cba", b"cbx", b"zzz"], [b"123x", b"123y", b"999"], 4))
    assert found == [(2, 3, [0, 1])] or found == [(2, 3, [1, 0])]


def test_media(docs, empty, spark, tmp_path):
    got = collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in media.round_trip(docs).collect())
    expected = collections.Counter()
    for doc_id, text in corpus():
        b = (text or "").encode()
        p = b.ljust(max(1, -(-len(b) // 64)) * 64, b"\0")
        expected[doc_id, len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert got == expected
    assert media.round_trip(empty).count() == 0
    stored = collections.defaultdict(set)
    for r in media.round_trip(docs).collect():
        stored[r.payload_sha256, r.n_bytes].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(v) == 1 for v in stored.values())
    by_text = {hashlib.sha256(media.payload_of((t or "").encode())).hexdigest(): (t or "").encode() for _, t in corpus()}
    for (sha, n_bytes), v in stored.items():
        made = media.encode(by_text[sha][:n_bytes].ljust(n_bytes, b"\0"))
        assert v == {(len(made), hashlib.sha256(made).hexdigest(), media.features(media.payload_of(by_text[sha])))}
    named = docs.select(F.concat(F.lit("n"), "doc_id").alias("doc_id"), "text")
    assert {r.doc_id for r in media.round_trip(named).collect()} == {None if i is None else f"n{i}" for i, _ in corpus()}


def test_media_retries_a_member_alone(tmp_path, docs):
    folder = f"file://{tmp_path}/a"
    media.write_archives(docs, folder, archive_bytes=2000)
    reader = media.ArchiveMediaReader(folder, 512, 3)
    parts = reader.partitions()
    assert len(parts) > 2
    system, _ = media.opened(folder)

    class Flaky:
        failures = 2

        def open_input_file(self, path):
            if Flaky.failures:
                Flaky.failures -= 1
                raise OSError("gone for now")
            return system.open_input_file(path)

    with system.open_input_file(parts[0].archive) as file, media.zipfile.ZipFile(file) as archive:
        info = archive.infolist()[0]
    assert media.decode(reader.fetch(Flaky(), parts[0].archive, info))[0] >= 0
    class Short:
        """The first file ends inside the header."""

        failures = 1

        def open_input_file(self, path):
            import io

            if Short.failures:
                Short.failures -= 1
                return io.BytesIO(b"PK\3\4")
            return system.open_input_file(path)

    assert media.decode(reader.fetch(Short(), parts[0].archive, info))[0] >= 0
    Short.failures = 2
    assert len(reader.directory(Short(), parts[0].archive)) > 0
    Flaky.failures = 3
    with pytest.raises(OSError):
        reader.fetch(Flaky(), parts[0].archive, info)
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == len(corpus())


def test_sharding(docs, empty):
    got = sharding.shard(docs, 5).toPandas()
    assert len(got) == len(corpus())
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    sizes = [got["size"][got.shard == s].sum() for s in range(5)]
    assert max(sizes) - min(sizes) <= 2 * got["size"].max()
    expected = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in corpus())
    assert sorted(zip(got["size"], got.text_crc32)) == expected
    assert sharding.shard(empty, 5).count() == 0


def test_sharding_splits_equal_rows(spark):
    same = frame(spark, [(7, "same text")] * 100)
    got = sharding.shard(same, 4).toPandas()
    assert sorted(got.groupby("shard").size()) == [25, 25, 25, 25]


def plain_line_dedup(rows):
    keys, last = collections.defaultdict(set), 1 << 70
    order = lambda i: last if i is None else i
    strip = " \t\n\x0b\x0c\r"
    for i, t in rows:
        for x in (t or "").split("\n"):
            keys[x.strip(strip).translate(LOW)].add(order(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(k := x.strip(strip).translate(LOW)) < 10 or len(keys[k]) < 2 or order(i) == min(keys[k])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def test_line_dedup(docs, empty):
    assert rows(line_dedup.digest(docs)) == plain_line_dedup(corpus())
    assert line_dedup.digest(empty).count() == 0
    out = line_dedup.without_repeats(docs)
    assert out.columns == docs.columns and out.where("text IS NULL").count() == 1


def test_scoring_takes_little_memory():
    """A task scores a small part of an Arrow batch at a time, with the scores of the whole."""
    rng = random.Random(2)
    texts = pa.array([" ".join(f"{rng.randrange(100_000):x}" for _ in range(6000)) for _ in range(64)])
    batch = pa.RecordBatch.from_arrays([pa.StructArray.from_arrays([texts], ["text"])], names=["doc"])
    model = toxicity.Model(np.random.default_rng(1).normal(size=toxicity.BUCKETS), 0.0, 0.0)
    whole = model.score(texts)
    tracemalloc.start()
    got = list(toxicity.scored(iter([batch]), model))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(np.concatenate([np.asarray(b.column("score")) for b in got]), whole)
    assert peak < 60_000_000


def test_freed_memory_goes_back():
    """What a task freed below something that is still there doesn't stay with the worker."""
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    blocks = [bytearray(2000) for _ in range(50_000)]
    last = blocks[-1]
    held = resident()
    del blocks
    common.hand_back()
    assert held - resident() > 50_000_000 and len(last) == 2000


def test_pieces_of_filters_travel_small():
    """A task's filters take as much memory on their way as they have bits set, not as they have bits, and come out the same."""
    once, twice = np.zeros(line_dedup.PIECE_BITS // 8, np.uint8), np.zeros(line_dedup.PIECE_BITS // 8, np.uint8)
    line_dedup.put(once, twice, np.random.default_rng(3).integers(0, 1 << 63, (100, 2), np.int64).view(np.uint64))
    for piece in (once, twice, ~once, np.random.default_rng(4).integers(0, 256, len(once), np.int64).astype(np.uint8)):
        assert (line_dedup.unpacked(line_dedup.packed(piece), len(piece)) == piece).all()
    assert len(line_dedup.packed(once)) < len(once) // 20 and len(line_dedup.packed(twice)) < len(twice) // 100


def test_line_dedup_with_a_full_filter_is_the_same(docs, monkeypatch):
    monkeypatch.setattr(line_dedup, "LEAST_BITS", 64)
    monkeypatch.setattr(line_dedup, "MOST_BITS", 64)
    assert rows(line_dedup.digest(docs)) == plain_line_dedup(corpus())


def test_bloom_filters():
    rng = np.random.default_rng(1)
    once, twice = np.zeros(1 << 12, np.uint8), np.zeros(1 << 12, np.uint8)
    a, b = (rng.integers(0, 1 << 63, (200, 2)).astype(np.uint64) for _ in "ab")
    line_dedup.put(once, twice, a)
    assert line_dedup.holds(twice, a).sum() < 20
    line_dedup.put(once, twice, np.concatenate([a[:50], b]))
    assert line_dedup.holds(twice, a[:50]).all() and line_dedup.holds(twice, b).sum() < 40


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><ul><li><a href=x>Menu &amp; more</a></li></ul></nav>
<div class="ad">Buy</div>{body}<div id=comments><p>Reader: nice</div><footer>&copy; x</footer></body></html>"""


def test_html(spark, tmp_path):
    template = "<div><p>About this site</p></div>"
    plain = [f"<div><h2>Head {i}</h2><p>Story <b>num</b>ber&nbsp;{i}\n  goes<br>on</p></div>" for i in range(4)]
    pages = [(i, f"http://h.example/a/{i}", PAGE.format(body=template + p)) for i, p in enumerate(plain)]
    pages += [(10, "http://i.example/x", PAGE.format(body="<article><h1>A</h1><p>One<p>Two &lt;3</article><p>else")), (11, "http://i.example/y", PAGE.format(body="<article><h1>A</h1><p>One<p>Three</article>"))]
    pages += [(20, None, None), (21, "http://j.example/", ""), (None, "x", "no tags <b at all")]
    path = f"{tmp_path}/pages.parquet"
    spark.createDataFrame([(*p, "r") for p in pages], "page_id long, url string, html string, rid string").write.parquet(path)
    got = {r.page_id: r for r in html_text.extract(spark.read.parquet(path)).collect()}
    for i in range(4):
        assert got[i].text == f"Head {i}\n\nStory number {i} goes on" and got[i].n_chars == len(got[i].text)
    assert got[10].text == "A\n\nOne\n\nTwo <3" and got[11].text == "A\n\nOne\n\nThree"
    assert got[20].text == "" and got[21].text == "" and got[None].text.startswith("no tags")
    assert html_text.extract(spark.read.parquet(path).limit(0)).count() == 0


def test_common_subsequence():
    from cirrus.llm.alignment import common_length, common_places

    def plain(x, y):
        row = [0] * (len(y) + 1)
        for a in x:
            new = [0]
            for j, b in enumerate(y):
                new.append(row[j] + 1 if a == b else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        x, y = ([rng.randrange(4) for _ in range(rng.randrange(14))] for _ in "xy")
        places = common_places(x, y)
        assert common_length(x, y) == plain(x, y) == len(places)
        assert all(x[i] == y[j] for i, j in places) and all(a < c and b < d for (a, b), (c, d) in zip(places, places[1:]))
    assert len(common_places([1] * 50_000, [2] + [1] * 40_000 + [3])) == 40_000


def extracted(spark, path, pages):
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(path))
    return {r.page_id: r.text for r in html_text.extract(spark.read.parquet(str(path))).collect()}


def test_html_against_a_plain_differ(spark, tmp_path):
    """Pages without marks of any kind: what the page before or after it, as its path says, doesn't share in order."""
    rng = random.Random(6)
    pages = []
    for i in range(60):
        template = [f"Menu {k}" for k in range(rng.randrange(2, 6))], [f"Foot {k}" for k in range(rng.randrange(1, 4))]
        pages.append((i, f"http://h.example/{'ab'[i % 2]}/{i:03d}", template[0] + [f"Text {i} {k}" for k in range(rng.randrange(1, 5))] + template[1]))
    order = sorted(pages, key=lambda p: p[1])
    expected = {}
    for k, (i, url, own) in enumerate(order):
        near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order)]
        other = max(near, key=lambda p: html_text.alike(url[16:], p[1][16:]))[2]
        length = [[0] * (len(other) + 1) for _ in range(len(own) + 1)]
        for a in range(len(own) - 1, -1, -1):
            for b in range(len(other) - 1, -1, -1):
                length[a][b] = length[a + 1][b + 1] + 1 if own[a] == other[b] else max(length[a + 1][b], length[a][b + 1])
        a, b, kept = 0, 0, []
        while a < len(own):
            if b < len(other) and own[a] == other[b]:
                a, b = a + 1, b + 1
            elif b < len(other) and length[a][b + 1] >= length[a + 1][b]:
                b += 1
            else:
                kept.append(own[a])
                a += 1
        expected[i] = "\n\n".join(kept)
    got = extracted(spark, tmp_path / "p", [(i, u, "".join(f"<div>{x}</div>" for x in own)) for i, u, own in pages])
    assert got == expected


def test_html_compares_with_another_article(spark, tmp_path):
    """Neighbours that carry the same article are passed over."""
    body = lambda a: f"<div>Menu</div><article><p>One {a}</p><p>Two {a}</p></article><div>Foot</div>"
    run = [(i, "h", f"/{i}", [x.key() for x in found], [x.article for x in found]) for i, found in enumerate(html_text.lines(body(a)) for a in "aab")]
    assert html_text.shared_lines(run, 0) == html_text.shared_lines(run, 1) == html_text.shared_lines(run, 2) == [0, 3]


def test_html_neighbours_of_another_article_beyond_the_run(spark, tmp_path, monkeypatch):
    """Versions of one article fill several runs; whatever the length of a run, each page is compared with the nearest other article of its host."""
    page = lambda a, i: f"<div>Menu {a[0]}</div><div>Foot</div><article><p>One {a}</p><p>Two {a}</p><p>Three {a}</p><p>v {i}</p></article><aside>x</aside><ul><li>List {a[0]}</li></ul>"
    names = ["p"] + ["q"] * 23 + ["pz"] + ["q"] * 9 + ["px"] * 2
    rows = [(i, f"http://h.example/{i:03}", page(a, i)) for i, a in enumerate(names)] + [(90 + i, f"http://i.example/{i:03}", page("r", i)) for i in range(9)]
    path = str(tmp_path / "pages")
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2).write.parquet(path)
    found = [sorted((r.page_id, sorted(s)) for r, s in ((r, r.shared) for r in shared_by_page(spark.read.parquet(path), monkeypatch, n))) for n in (256, 4)]
    assert found[0] == found[1] and {i for i, _ in found[0]} == set(range(len(names)))


def shared_by_page(pages, monkeypatch, run):
    from cirrus.llm.common import with_rid

    monkeypatch.setattr(html_text, "RUN", run)
    shared = html_text.template_lines(with_rid(pages, "url", "html"))
    return with_rid(pages, "page_id").join(shared, "rid").select("page_id", "shared").collect()


def test_html_equal_pages_have_equal_texts(spark, tmp_path):
    page = lambda a: f"<html><body><div><p>About this site</p></div><div><p>Text {a}</p></div></body></html>"
    pages = [(i, f"http://h.example/a/{i}", page(0)) for i in range(5)] + [(9, "http://h.example/z", page(1))]
    assert extracted(spark, tmp_path / "p", pages) == {**dict.fromkeys(range(5), "Text 0"), 9: "Text 1"}


def test_html_drops_nothing_of_an_article_by_parts_of_names(spark, tmp_path):
    page = '<html><body><article><header><h1>Head</h1></header><p class="search-space">A <math><mi>x</mi></math> b</p><p id="related-work">C</p><div class="comments"><p>No</p></div><div class="ad">No</div></article></body></html>'
    assert extracted(spark, tmp_path / "p", [(1, "http://h.example/a", page)]) == {1: "Head\n\nA x b\n\nC"}


def test_html_shared_boxes_of_articles_go_and_quotations_stay(spark, tmp_path):
    """Differencing decides inside a marked article too: a box that the neighbour has goes, the body and lines of it that both have stay."""
    page = lambda a: f'<html><body><article><h1>Head {a}</h1><div class="body"><p>One {a}</p><p>Both quote this</p><p>Two {a}</p><p>Three {a}</p><ul><li>Item {a}</li><li>Both list this</li></ul></div><div class="box"><p>Write to us</p><ul><li>By mail</li></ul></div></article></body></html>'
    text = lambda a: "\n\n".join([f"Head {a}", f"One {a}", "Both quote this", f"Two {a}", f"Three {a}", f"Item {a}", "Both list this"])
    pages = [(i, f"http://h.example/a/{i}", page(i)) for i in range(4)] + [(9, "http://i.example/a", page(9))]
    assert extracted(spark, tmp_path / "p", pages) == {**{i: text(i) for i in range(4)}, 9: text(9) + "\n\nWrite to us\n\nBy mail"}


def test_decontamination(spark, docs, empty):
    texts = corpus()
    items = [(1, texts[0][1]), (2, " ".join(texts[1][1].split()[5:20])), (3, "one two"), (10, None), (11, ""), (None, texts[60 % len(texts)][1]), (2, "be")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    find = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: find.findall((t or "").translate(LOW))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows[tuple(w[k : k + 10])].add("null" if i is None else str(i))
    expected = []
    for i, t in texts:
        w, hit, names = split(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    names |= found
                    hit |= set(range(k, k + n))
        expected.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    assert rows(decontamination.digest(docs, bench)) == sorted(expected, key=repr)
    assert decontamination.digest(empty, bench).count() == 0
    assert decontamination.digest(docs, bench.limit(0)).where("contaminated").count() == 0
    cleaned = decontamination.remove(docs, bench)
    assert cleaned.columns == docs.columns
    assert decontamination.digest(cleaned, bench.where("item_id = 1")).where("contaminated").count() == 0


def test_decontamination_by_blocks_is_the_same(spark, docs, monkeypatch):
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(x[1] for x in corpus()[:5])], "item_id long, text string")
    expected = rows(decontamination.digest(docs, bench))
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 10)
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (10,))
    assert rows(decontamination.digest(docs, bench)) == expected


def test_fm_index():
    rng = np.random.default_rng(3)
    text = np.append(rng.integers(1, 5, 300), 0)
    index = decontamination.FmIndex(text)
    phrases = np.array([[1, 2, 3], [4, 4, 1], [9, 9, 9]])
    for p, lo, hi in zip(phrases, *index.search(phrases)):
        expected = [i for i in range(298) if (text[i : i + 3] == p).all()]
        assert sorted(index.locate(np.arange(lo, hi)).tolist()) == expected


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), 1 << 60))
    return [(doc_id, len(sets[i]), least.get(root(i)), doc_id == least.get(root(i))) for i, (doc_id, _) in enumerate(rows)]


def test_near_dedup(docs, empty):
    assert rows(near_dedup.digest(docs)) == sorted(plain_components(corpus()), key=repr)
    assert near_dedup.digest(empty).count() == 0
    kept = near_dedup.keep_one(docs)
    # one row for each group of texts with words, and each text without words
    assert kept.columns == docs.columns and kept.count() == len({c for _, n, c, _ in plain_components(corpus()) if n}) + 3


def test_near_dedup_where_groups_only_nearly_hang_together(spark):
    import random

    rng = random.Random(9)
    base = [f"t{i}" for i in range(120)]
    texts = []
    for i in range(120):
        w = base.copy()
        for k in rng.sample(range(120), rng.randrange(0, 7)):
            w[k] = f"edit{i}{k}"
        texts.append((1000 - i, " ".join(w)))
    assert rows(near_dedup.digest(frame(spark, texts))) == sorted(plain_components(texts), key=repr)


def test_registers_estimate_overlap():
    rng = np.random.default_rng(0)
    both, one, two = (rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (750, 125, 125))
    x, y = near_dedup.registers(np.append(both, one)), near_dedup.registers(np.append(both, two))
    merged = np.maximum(x, y)
    assert (merged == near_dedup.registers(np.concatenate([both, one, two]))).all()
    found = near_dedup.overlap(np.array([(x > y).sum()]), np.array([(x < y).sum()]), np.array([875.0]), np.array([875.0]))[0]
    assert abs(found - 0.75) < 0.12


def test_toxicity(spark, tmp_path):
    import random

    rng = random.Random(2)
    texts, labels = [], []
    for i in range(1200):
        w = [f"w{rng.randrange(300)}x" for _ in range(rng.randrange(20, 200))]
        if toxic := i % 4 == 0:
            for k in rng.sample(range(len(w)), max(1, len(w) // 40)):
                w[k] = rng.choice(["horrid", "vilest", "wretched"])
        texts.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    texts += [(None, "x"), (2000, None), (2001, ""), (2002, "horridd wretchedd " * 3), (2003, "be " * 500)]
    docs, marked = frame(spark, texts), spark.createDataFrame([*labels, (2001, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.digest(docs, marked).collect()}
    held = [r for r in got.values() if r.held_out and r.doc_id is not None and r.doc_id < 1200]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got.values() if r.doc_id is not None)
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.95
    assert got[2002].predicted == 1 and got[2003].predicted == 0 and got[2000].score == got[2001].score
    assert all(0 <= r.score <= 1 for r in got.values())
    assert {r.predicted for r in toxicity.digest(docs, marked.limit(0)).collect()} == {0}
    assert toxicity.digest(frame(spark, []), marked).count() == 0


def test_toxic_passage_of_words_seen_before():
    """A dense insult counts where each of its words has stood before, far apart in clean text."""
    import random

    import pyarrow as pa

    rng = random.Random(3)
    bad = [f"vile{k}" for k in range(12)]
    clean = lambda n: [f"w{rng.randrange(300)}x" for _ in range(n)]
    texts, toxic = [], []
    for i in range(600):
        w = clean(100)
        if i % 3 == 0:
            w[40:40] = rng.sample(bad, 8)
        elif i % 3 == 1:
            w[40] = rng.choice(bad)
        texts.append(" ".join(w))
        toxic.append(int(i % 3 == 0))
    model = toxicity.fit(texts, np.array(toxic))
    apart = [x for b in bad for x in [*clean(120), b]]
    scores = model.score(pa.array([" ".join(apart), " ".join(apart + clean(120) + bad), " ".join(clean(50)), " ".join(["vile1"] + ["be"] * 40), "vile1 be"]))
    assert (scores[:3] >= 0.5).tolist() == [False, True, False]
    assert abs(scores[3] - scores[4]) < 1e-9  # a word's repeats weigh nothing


def test_chaining(docs, empty, spark):
    split = lambda t: (t or "").encode().translate(decontamination.WORD_BYTES).split()
    runs = collections.defaultdict(set)
    for k, (_, t) in enumerate(corpus()):
        w = split(t)
        for a in range(len(w) - 49):
            runs[tuple(w[a : a + 50])].add(k)
    expected = {corpus()[k][0] for v in runs.values() if len(v) > 1 for k in v}
    got = chaining.passages(docs).toPandas()
    found = set(got.doc_id.dropna()) | set(got.other_doc_id.dropna())
    assert expected - {None} <= found
    assert found <= {*range(0, 12), *range(20, 32), 43, 50} | {40}
    assert ((got.similarity >= 0.75) & (got.end - got.start >= 50)).all()
    assert chaining.passages(empty).count() == 0


def test_fuzzy_passage_inside_other_texts(spark):
    import random

    rng = random.Random(4)
    passage = [f"p{i}" for i in range(90)]
    changed = passage.copy()
    changed[25:26] = ["new", "words"]
    changed[60:61] = []
    noise = lambda k: [f"n{k}{rng.randrange(10**6)}" for _ in range(80)]
    texts = [(1, " ".join(noise(1) + passage + noise(2))), (2, " ".join(noise(3) + changed + noise(4))), (3, " ".join(noise(5)))]
    got = chaining.passages(frame(spark, texts)).collect()
    assert len(got) == 1 and {got[0].doc_id, got[0].other_doc_id} == {1, 2}
    assert abs(got[0].start - 80) <= 1 and abs(got[0].other_end - 170) <= 1 and got[0].similarity > 0.9


def test_chains_are_collinear():
    runs = [(i * 7, i * 7 + 3, 4) for i in range(10)] + [(5, 60, 3), (33, 2, 3)]
    assert chaining.chains(runs)[0] == runs[:10]


def in_order(spark, texts):
    import tempfile

    path = tempfile.mkdtemp(prefix="cirrus-test-") + "/documents.parquet"
    spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def covered(got, k):
    """The words of document k that lie in a passage."""
    out = set()
    for r in got:
        out |= set(range(r.start, r.end)) if r.doc_id == k else set()
        out |= set(range(r.other_start, r.other_end)) if r.other_doc_id == k else set()
    return out


def test_passage_between_holders_of_its_parts(spark):
    a, b = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    noise = lambda k: [f"n{k}v{i}" for i in range(70)]
    texts = [noise(0) + a, b + noise(1), noise(2) + a + b + noise(3), noise(4) + a + b, a + noise(5), noise(6) + b]
    got = chaining.passages(in_order(spark, texts)).collect()
    assert [(r.doc_id, r.other_doc_id, r.start, r.end, r.other_start, r.other_end) for r in got] == [(3, 2, 70, 150, 70, 150)]


def test_exact_passages_as_by_brute_force(spark):
    import random

    rng = random.Random(8)
    passages = [[f"p{k}v{i}" for i in range(rng.randrange(61, 130))] for k in range(6)]
    texts = []
    for k in range(60):
        text = [f"n{k}v{i}" for i in range(40)]
        for p in rng.sample(passages, 2):
            if k < 15 or k >= 45:  # part-holders at both ends
                a = rng.randrange(len(p) - 45)
                p = p[a : a + 45]
            text += p + [f"m{k}v{rng.randrange(10**6)}" for _ in range(20)]
        texts.append(text)
    holders = collections.defaultdict(set)
    for k, w in enumerate(texts):
        for a in range(len(w) - 49):
            holders[tuple(w[a : a + 50])].add((k, a))
    expected = collections.defaultdict(set)
    for found in holders.values():
        if len({k for k, _ in found}) > 1:
            for k, a in found:
                expected[k] |= set(range(a, a + 50))
    got = chaining.passages(in_order(spark, texts)).collect()
    assert len(expected) == 30
    assert all(v <= covered(got, k) for k, v in expected.items())


def test_passage_after_quotes_of_its_halves(spark):
    a, b = [f"a{i}" for i in range(35)], [f"b{i}" for i in range(35)]
    noise = lambda k, n: [f"n{k}v{i}" for i in range(n)]
    texts = [noise(0, 9) + a + noise(1, 400) + b + noise(2, 300) + a + b + noise(3, 9) + a + b, noise(4, 50) + a + b]
    got = chaining.passages(in_order(spark, texts)).collect()
    assert sorted((r.doc_id, r.other_doc_id, r.start, r.end, r.other_start, r.other_end) for r in got) == [(1, 0, 50, 120, 779, 849), (1, 0, 50, 120, 858, 928)]


def test_words_without_end_are_one_passage():
    x, y = chaining.Words(np.full(900, 7, np.uint64)), chaining.Words(np.full(700, 7, np.uint64))
    runs = chaining.equal_runs(x, y)
    assert len(runs) < 1700
    got = chaining.aligned(chaining.chains(runs), x.word, y.word)
    assert got[0][1] - got[0][0] >= 700 and got[0][3] - got[0][2] == 700


def test_texts_of_three_words_end_in_bounded_time():
    rng = np.random.default_rng(1)
    x, y = (chaining.Words(rng.integers(1, 4, 8000).astype(np.uint64)) for _ in "xy")
    assert len(chaining.equal_runs(x, y)) <= chaining.MANY_RUNS


def test_passage_whose_pieces_many_others_hold(spark):
    """B and C share 120 words; 14 documents before and 14 after hold 24 of them each."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(120)]
    noise = lambda k: [f"n{k}v{i}" for i in range(60)]
    pieces = [noise(k) + passage[a : a + 24] for k, a in enumerate(rng.randrange(97) for _ in range(28))]
    texts = [*pieces[:14], noise(50) + passage + noise(51), noise(52) + passage, *pieces[14:]]
    got = chaining.passages(in_order(spark, texts)).collect()
    assert [(r.doc_id, r.other_doc_id, r.start, r.end, r.other_start, r.other_end) for r in got] == [(15, 14, 60, 180, 60, 180)]


def test_two_passages_far_apart_are_two_rows(spark):
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    noise = lambda k, n: [f"n{k}v{i}" for i in range(n)]
    got = chaining.passages(in_order(spark, [a + noise(0, 150) + b, a + noise(1, 150) + b])).collect()
    assert sorted((r.start, r.end) for r in got) == [(0, 60), (210, 270)]


@pytest.mark.parametrize("every", [4, 5, 8])
def test_every_few_words_changed(spark, every):
    p = [f"p{i}" for i in range(160)]
    q = [f"q{i}" if i % every == 0 else w for i, w in enumerate(p)]
    noise = lambda k: [f"n{k}v{i}" for i in range(40)]
    got = chaining.passages(in_order(spark, [noise(0) + p + noise(1), noise(2) + q + noise(3)])).collect()
    assert covered(got, 1) >= set(range(41, 196))


def test_recall_by_similarity(spark):
    """100 pairs of passages of 50 to 80 words for each band of likeness, words changed at random; the best row has to cover most of it."""
    for like in (0.76, 0.82, 0.9):
        rng = random.Random(int(100 * like))
        texts, n = [], {}
        for k in range(100):
            p = [f"p{k}v{i}" for i in range(rng.randrange(50, 81))]
            q = p.copy()
            for i in rng.sample(range(len(p)), int(len(p) * (1 - like))):
                q[i] = f"q{k}v{i}"
            noise = lambda: [f"n{rng.randrange(10**9)}" for _ in range(30)]
            texts += [noise() + p + noise(), noise() + q + noise()]
            n[k] = len(p)
        got = chaining.passages(in_order(spark, texts)).collect()
        assert all(r.doc_id == r.other_doc_id + 1 and r.other_doc_id % 2 == 0 for r in got)
        found = sum(len(covered(got, 2 * k) & set(range(30, 30 + n[k]))) >= 45 for k in n)
        print(f"likeness {like}: {found} of {len(n)}")
        assert found >= 90
