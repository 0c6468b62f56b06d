"""Fill-in-the-middle, packing by powers of two and the Merkle manifest against plain versions of their contracts."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cirrus.llm import decomposition, fill_middle, merkle, packing
from llm_helpers import corpus, frame

LONG = "".join(random.Random(9).choice("aé語😀b \n") for _ in range(60_000))
MARKED = [(70, "a <P> b"), (71, "x" * 300 + "<" + "S>"), (72, "<<P"), (73, "P>S><M"), (74, "<S<S<"), (75, ">" * 500 + "<M>"), (76, LONG), (77, LONG + "tail"), (78, "né" + LONG), (79, "z" * 200_000), (80, "\x00\x01" * 700)]


def tricky():
    return corpus() + MARKED


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, tricky())


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill in the middle ---------------------------------------------------------------------------------------------


def plain_cut(doc_id, text):
    t = text or ""
    n, h = len(t), sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "<P>" + t[:a], "<M>" + t[a:b], "<S>" + t[b:]
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    return (n, "spm", a, b - a, s + p + m) if h4 % 100 < 20 else (n, "psm", a, b - a, p + s + m)


def test_fill_in_middle(docs, empty):
    expected = [(i, *plain_cut(i, t)) for i, t in tricky()]
    assert rows(fill_middle.transform(docs)) == sorted(expected, key=repr)
    assert rows(fill_middle.digest(docs)) == sorted([(*e[:-1], sha(e[-1]), sha(t or "")) for e, (_, t) in zip(expected, tricky())], key=repr)
    assert {e[2] for e in expected} == {"plain", "psm", "spm"}
    assert fill_middle.digest(empty).count() == 0


def test_texts_of_other_forms_come_back(spark):
    """Text that ends or begins like a mark, next to the marks put in."""
    few = ["<", "<P", ">", "P>", "<S", "<M", "é<", ">é", "😀"]
    texts = [(i, a + b + c) for i, (a, b, c) in enumerate((a, b, c) for a in few for b in few for c in few)]
    got = rows(fill_middle.digest(frame(spark, texts)))
    assert got == sorted([(i, *plain_cut(i, t)[:-1], sha(plain_cut(i, t)[-1]), sha(t)) for i, t in texts], key=repr)


@pytest.mark.parametrize("most", [3, 64, 1 << 16])
def test_counts_and_marks_of_chunks(monkeypatch, most):
    """Places and marks found through chunks are those of the text, however the chunks fall."""
    monkeypatch.setattr(fill_middle, "MOST", most)
    monkeypatch.setattr(fill_middle, "BLOCK", 1000)
    rng, cache = random.Random(3), fill_middle.Chunks()
    for trial in range(300):
        text = "".join(rng.choice(["a", "é", "語", "😀", "<", "P", ">", "word "]) for _ in range(rng.choice([0, 1, 5, 70, 3000])))
        found = fill_middle.Counted(text.encode(), cache)
        assert found.ends == sorted(set(found.ends)) and (found.ends[-1] if text else 0) == len(text.encode())
        assert found.points == len(text) and found.marked == ("<P>" in text)
        for point in {0, len(text), rng.randrange(len(text) + 1), len(text) // 2}:
            assert found.byte_of(point) == len(text[:point].encode())


def test_shared_passages_share_chunks():
    """A passage behind different beginnings is cut alike but for its first chunk, and the cache computes its chunks once."""
    rng = random.Random(4)
    passage = bytes(rng.randrange(97, 123) for _ in range(200_000))
    cuts = [set(e - len(head) for e in fill_middle.chunk_ends(head + passage)) for head in (b"", b"x", b"another beginning " * 30)]
    assert len(cuts[0]) > 20 and all(len(cuts[0] ^ c) <= 3 for c in cuts)
    cache = fill_middle.Chunks()
    fill_middle.Counted(b"head" + passage, cache)
    met = cache.hits
    fill_middle.Counted(b"another" + passage, cache)
    assert cache.hits - met > 20


def test_cache_trusts_content_only(monkeypatch):
    monkeypatch.setattr(fill_middle.xxhash, "xxh3_64_intdigest", lambda chunk: 7)
    monkeypatch.setattr(fill_middle, "REMEMBERED", 100)
    cache = fill_middle.Chunks()
    for text in ("abc", "é" * 50, "abc", "<P>", "é" * 50):
        assert cache.summary(text.encode())[:2] == (len(text), text == "<P>")


# ---- powers of two --------------------------------------------------------------------------------------------------


def test_power_of_two_packing(docs, empty):
    from tokenizers import Tokenizer

    tokenizer, expected = Tokenizer.from_file(packing.tokenizer_path()), []
    for doc_id, text in tricky():
        ids, at = tokenizer.encode(text or "", add_special_tokens=False).ids + [1], 0
        sizes = [2048] * (len(ids) // 2048) + [s for s in (1024, 512, 256, 128, 64, 32, 16, 8, 4, 2, 1) if len(ids) & s]
        assert sum(sizes) == len(ids)
        for s in sizes:
            expected.append((doc_id, at, s, zlib.crc32(np.array(ids[at : at + s], "<u4").tobytes()), len(ids), s.bit_length() - 1, 0))
            at += s
    got = decomposition.sequences(docs, with_ids=True)
    assert rows(got.drop("sequence_id", "ids")) == sorted(expected, key=repr)
    found = got.collect()
    assert len({r.sequence_id for r in found}) == len(found) and all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<i4").tobytes()) == r.ids_crc32 for r in found)
    assert decomposition.digest(empty).count() == 0
    with pytest.raises(ValueError):
        decomposition.sequences(docs, longest=1000)


def test_batches_and_buckets(spark, docs, tmp_path):
    found = decomposition.batched(decomposition.sequences(docs.coalesce(1), with_ids=True), 4096)
    per = found.groupBy("batch_id").agg(F.sum("length").alias("tokens"), F.countDistinct("bucket").alias("buckets"), F.first("bucket").alias("bucket")).collect()
    assert all(r.tokens <= 4096 and r.buckets == 1 for r in per)
    parts = {b: sum(r.tokens < 4096 for r in per if r.bucket == b) for b in {r.bucket for r in per}}
    assert max(parts.values()) <= 1
    decomposition.write_buckets(found, f"file://{tmp_path}/buckets")
    again = spark.read.parquet(f"file://{tmp_path}/buckets").where("bucket = 5")
    assert again.count() == found.where("length = 32").count() > 0


# ---- manifest -------------------------------------------------------------------------------------------------------


def plain_tree(leaves):
    """Root, and for each leaf the siblings on the left and on the right, level by level."""
    level, places, paths = list(leaves), list(range(len(leaves))), [[] for _ in leaves]
    while len(level) > 1:
        for k, at in enumerate(places):
            a = at - at % 3
            paths[k].append(("".join(level[a:at]), "".join(level[at + 1 : a + 3])))
            places[k] = at // 3
        level = [sha("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def plain_leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def plain_manifest(table):
    groups, out = {}, []
    for doc_id, source, lang, n_chars, text in table:
        cut = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None
        tampered = text.replace("\n", "") if cut else text
        groups.setdefault(source, []).append((doc_id, plain_leaf(doc_id, source, lang, n_chars, text), plain_leaf(doc_id, source, lang, n_chars, tampered)))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = [plain_tree([r[1] for r in groups[g]]) for g in names]
    root, upper = plain_tree([t[0] for t in trees])
    for g, (subroot, paths), above in zip(names, trees, upper):
        for (doc_id, leaf, tampered), path in zip(groups[g], paths):
            h = tampered
            for left, right in path + above:
                h = sha(left + h + right)
            out.append((doc_id, leaf, subroot, root, sha("".join(a + b for a, b in path + above)), h, h == root))
    return sorted(out, key=repr)


def stored(spark, table, tmp_path):
    path = f"file://{tmp_path}/documents.parquet"
    spark.createDataFrame(table, "doc_id long, source string, lang string, n_chars long, text string").withColumn("g", F.lit("g")).withColumn("rid", F.lit("r")).withColumn("node", F.lit(1)).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def test_manifest_of_awkward_rows(docs, empty):
    table = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
    assert rows(merkle.digest(docs)) == plain_manifest(table)
    assert merkle.digest(empty).count() == 0


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 1, None: 1}, {"a": 3, "b": 4, "": 9, None: 10}, {"a": 82, "é": 81, "z": 1}, {"hot": 700, **{f"s{i}": 1 for i in range(90)}}])
def test_manifest_of_groups(spark, tmp_path, monkeypatch, sizes):
    """Lone leaves, whole and broken blocks, a hot source over several slabs, more sources than a block holds."""
    monkeypatch.setattr(merkle, "SLAB_ROWS", 100)
    rng = random.Random(7)
    table = [(rng.randrange(10**6), s, rng.choice([None, "en"]), rng.choice([None, 5]), rng.choice([None, "", "a\nb", "ünï\n\n"])) for s, n in sizes.items() for _ in range(n)]
    assert rows(merkle.digest(stored(spark, table, tmp_path))) == plain_manifest(table)


def test_stored_levels_and_proofs(spark, tmp_path):
    """Only every second level is stored, and each row's proof leads to the root."""
    table = [(i, "one" if i % 3 else "two", "en", 1, f"t{i}") for i in range(300)]
    d = stored(spark, table, tmp_path)
    made = merkle.build(d.select("doc_id", "source", merkle.leaf([F.col(c) for c in merkle.FIELDS]).alias("node")), "source", ["doc_id"], "doc_id", step=2)
    assert [s.agg(F.sum(F.size("nodes"))).first()[0] for s in made.trees.stored] == [300, 35, 5]
    got = merkle.proofs(made).select("g", merkle.folded(F.col("item.node"), F.col("path")).alias("h")).distinct().collect()
    assert {r.h for r in got} == {merkle.root(made)} and {r.g for r in got} == {"1one", "1two"}
    assert merkle.root(made) == plain_manifest(table)[0][3]
