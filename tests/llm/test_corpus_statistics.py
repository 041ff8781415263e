"""Encoding, source divergence and phrases against the library and brute force, and on the odd cases."""

import hashlib
import random
from collections import Counter

import brute
import numpy as np
import public_tokenizers
import pytest
from conftest import WORDS, prose
from tokenizers import Tokenizer

from shelfscan.llm import bpe, divergence, phrases
from shelfscan.llm.queries import QUERIES
from shelfscan.llm.transducer import Builder, Transducer

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
SF = "/root/testdata/sf0.001"


def sha(raw):
    return hashlib.sha256(raw).hexdigest()


def library_digest(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(np.array(ids, "<u4").tobytes()), sha(LIBRARY.decode(ids, skip_special_tokens=False).encode())


def digests(df):
    return {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()}


def table(spark, rows):
    """Rows of (lang, source, text) with columns named like those the operators use themselves."""
    rows = [(i, *r, "x", 7, "h", 9) for i, r in enumerate(rows)]
    return spark.createDataFrame(rows, "doc_id long, lang string, source string, text string, term string, n long, hash string, shard int")


# -- encoding and decoding ----------------------------------------------------


def compiled(path, words):
    known, builder = bpe.vocabulary(PATH), Builder()
    for w in sorted(x.encode() for x in words):
        builder.add(w, tuple(known.encode_word(w.decode())))
    builder.write(str(path))
    return Transducer(str(path)), builder


def looked_up(transducer, words):
    raw = [w.encode() for w in words]
    known, counts, ids = transducer.look_up(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    ends = np.cumsum([0, *counts.tolist()])
    return {w: ids[a:b].tolist() if k else None for w, k, a, b in zip(words, known, ends, ends[1:])}


def test_transducer_gives_the_ids_of_its_words_only(tmp_path):
    r = random.Random(4)
    words = sorted({"".join(r.choice(WORDS) for _ in range(r.randint(1, 4))) for _ in range(800)} | {"a", "ab", "don't!!", "日本", "😀"})
    inside, outside = words[::2], words[1::2]
    transducer, builder = compiled(tmp_path / "one", inside)
    known = bpe.vocabulary(PATH)
    assert looked_up(transducer, words) == {w: known.encode_word(w) for w in inside} | dict.fromkeys(outside)
    assert len(builder.states) < len({w[:i] for w in inside for i in range(len(w) + 1)})


def test_transducer_is_minimal(tmp_path):
    """Words with like endings and like ids share states: as many states as there are different sets of endings."""
    builder = Builder()
    for w in sorted([a + b for a in ("ab", "cd", "ef") for b in ("ing", "ings", "ed")]):
        builder.add(w.encode(), (ord(w[0]), 1 if w.endswith("ed") else 2))
    builder.write(str(tmp_path / "two"))
    # a start, one state behind each first letter, then the shared tree of endings: -, e, i, in, and the ends
    assert len(builder.states) == 1 + 3 + 1 + 1 + 2 + 2
    empty = Builder()
    empty.write(str(tmp_path / "none"))
    assert looked_up(Transducer(str(tmp_path / "none")), ["a", "b"]) == {"a": None, "b": None}


def test_words_as_the_library_has_them():
    r = random.Random(6)
    pieces = ["a", "B", "é", "é", " ", "\n", "\t", "1", "²", "'s", "'LL", "!", "?!", "Σ", "İ", "ß", "日本", "\x1c", "\x00", "́", "😀", "ﬁ", " ", "Ⅷ",
              "<|endoftext|>", "<|startoftext|>", "<|end", "a" * 40, "Ᲊ", "\U00010d50", "՘", "\U00012550"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 50))) for _ in range(1500)] + ["ab" * 30000, "é" * 9000, "x" * 30000 + " !" * 500]
    known = bpe.vocabulary(PATH)
    for t in texts:
        parts = [part for part in known.words(t) if part]
        ids = [i for part in parts for i in ([known.special[part[0][1:]]] if part[0][0] == " " else known.encode_words(part)[0].tolist())]
        assert ids == LIBRARY.encode(t, add_special_tokens=False).ids


def test_long_texts_are_read_in_parts(monkeypatch):
    text = prose(7, 3000) + " <|endoftext|> é" + prose(8, 100)
    whole = [w for part in bpe.vocabulary(PATH).words(text) for w in part]
    monkeypatch.setattr(bpe, "PART", 50)
    parts = list(bpe.vocabulary(PATH).words(text))
    assert len(parts) > 200 and [w for part in parts for w in part] == whole


@pytest.mark.parametrize("most", [0, 20, bpe.LEXICON])
def test_round_trip(spark, docs, numbered, most):
    lists = bpe.encode(docs, PATH, most)
    decoded = bpe.decode(lists, PATH)
    for r in decoded.collect():
        want = LIBRARY.encode(dict(numbered)[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids, r.decoded) == (len(want), want, LIBRARY.decode(want, skip_special_tokens=False))


def test_packed_digest(docs, numbered):
    assert digests(bpe.round_trip_digest(docs, PATH)) == {i: library_digest(t) for i, t in numbered}


def test_encoding_odd_tables(spark, docs):
    assert bpe.round_trip_digest(docs.filter("false"), PATH).count() == 0
    twice = spark.createDataFrame([(None, "Same <|endoftext|> text"), (None, "Same <|endoftext|> text"), (5, None)], "doc_id long, text string")
    found = bpe.round_trip_digest(twice, PATH).collect()
    assert sorted((r.doc_id is None, r.n_tokens) for r in found) == [(False, 0), (True, 3), (True, 3)]
    assert bpe.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PATH).first().decoded == ""


def test_frequent_words_are_taken_by_steps(spark):
    counts = spark.createDataFrame([("a", 900), ("b", 100), ("c", 100), ("d", 1), ("x" * 60, 5000), (" <|endoftext|>", 5000)], "word string, n long")
    assert [sorted(bpe.frequent_words(counts, m)) for m in (0, 1, 2, 3, 9)] == [[], ["a"], ["a"], ["a", "b", "c"], ["a", "b", "c", "d"]]


def test_query_as_the_library(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert digests(QUERIES["op11_bpe"](spark, SF)) == {i: library_digest(t) for i, t in texts.items()}


# -- source divergence --------------------------------------------------------


def speaking():
    r = random.Random(9)
    rows = []
    for i in range(160):
        lang, source = r.choice(["en", "en", "de", None]), f"s{r.randint(0, 3)}"
        words = [r.choice(WORDS[: 9 if source == "s1" else 30]).title() for _ in range(r.randint(0, 40))]
        rows.append((lang, source if i % 17 else None, " 7_".join(words)))
    rows += [("fr", "alone", "un deux"), ("it", "a", "x"), ("it", "b", None), ("en", "hush", ""), ("en", "s1", "thAn " * 5000), rows[0], rows[0]]
    return rows


def results(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("cells", [divergence.CELLS, 16])
@pytest.mark.parametrize("least", [10, 1])
def test_divergences(spark, least, cells):
    rows = speaking()
    got = divergence.divergences(table(spark, rows).repartition(5), least_docs=least, cells=cells)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert results(got) == brute.op12(rows, least)


def test_divergence_of_nothing(spark):
    assert divergence.divergences(table(spark, [("a", "b", "c")]).filter("false")).count() == 0
    two = [("en", "a", "few words"), ("en", "b", None), ("en", None, "Few")]
    assert results(divergence.divergences(table(spark, two))) == brute.op12(two)
    assert all(r[4] == 0 for r in brute.op12(two)) and len(brute.op12(two)) == 6


def test_ratio_is_exact_for_large_numbers():
    part, whole = np.array([0, 1, 10**15, 4 * 10**15 + 7, 9 * 10**15 - 1, 9 * 10**15]), 9 * 10**15
    assert divergence.ratio(part, whole).tolist() == [1 + 10**9 * int(c) // whole for c in part]


def test_counts_of_many_chunks(spark, monkeypatch):
    rows = [("en", f"s{i % 2}", f"one two w{i % 7} one") for i in range(400)]
    monkeypatch.setattr(divergence, "CHUNK", 64)
    monkeypatch.setattr(divergence, "HELD", 8)
    import pyarrow as pa

    columns = [pa.array([r[i] for r in rows]) for i in range(3)]
    batch = pa.RecordBatch.from_arrays(columns, names=["lang", "source", "text"])
    found = divergence._merged([pa.Table.from_batches([b]) for b in divergence._partial_counts(iter([batch]))])
    assert {(r["source"], r["term"]): (r["n"], r["docs"]) for r in found.to_pylist()}["s0", "one"] == (400, 200)


# -- phrases ------------------------------------------------------------------


def telling(n=260):
    r = random.Random(11)
    rows = []
    for i in range(n):
        words = [r.choice(WORDS[:14]) for _ in range(r.randint(0, 60))]
        if i % 3 == 0:
            words[5:5] = ["New", "york", "stock", "exchange", "today"]
        if i % 4 == 0:
            words += ["on", "the", "other\thand"]
        rows.append((r.choice(["en", "en", None, "de"]), "s", "".join(w + r.choice([" ", " ", " ", "  ", ", ", ".\n", ";"]) for w in words)))
    return rows + [("en", "s", None), ("en", "s", " \t,.;"), ("fr", "s", "ha " * 400), ("en", "s", "x" * 100000), rows[0], rows[0]]


@pytest.mark.parametrize("support", [1, 3, 12, 100])
def test_collocations(spark, support):
    rows = telling(260 if support > 1 else 40)
    got = phrases.collocations(table(spark, rows).repartition(6), support, 300)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert results(got) == brute.op13([(lang, t) for lang, _, t in rows], support, 300)


def test_every_frequent_phrase_with_its_count(spark):
    """Also where no bit table tells anything: all bits of one table stand for the same place."""
    rows = telling()
    found, sizes = phrases.frequent_phrases(table(spark, rows).repartition(9), 5)
    counts = {}
    for lang, _, t in rows:
        for piece in brute.re.split(r"[.,;:!?\x0A-\x0D]", brute.low(t)):
            w = brute.re.findall(r"[^\x20\x09]+", piece)
            for m in range(1, 6):
                for i in range(len(w) - m + 1):
                    key = (lang or "und", " ".join(w[i : i + m]))
                    counts[key] = counts.get(key, 0) + 1
    assert {(r.lang, r.phrase): r.f for r in found.collect()} == {k: n for k, n in counts.items() if n >= 5}
    assert {r.lang: r.n for r in sizes.collect()} == {x: sum(n for (lang, p), n in counts.items() if lang == x and " " not in p) for x in {k[0] for k in counts}}


def test_languages_beyond_the_table_lose_nothing(spark, monkeypatch):
    rows = telling()
    monkeypatch.setattr(phrases, "LANGUAGES", 1)
    got = phrases.collocations(table(spark, rows).repartition(4), 12, 300)
    assert results(got) == brute.op13([(lang, t) for lang, _, t in rows], 12, 300)


def test_many_shards_in_a_task(monkeypatch):
    """What shards name covers every frequent phrase, however rows fall into shards."""
    import pyarrow as pa

    rows = [r for r in telling() if r[0] == "en"]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[2] for r in rows])], names=["lang", "text"])
    monkeypatch.setattr(phrases, "CHUNK", 500)
    shards = list(phrases._shards(iter([batch]), 400))
    assert len(shards) > 10
    total, found = sum(len(s.word) for s in shards), set()
    for s in shards:
        local = max(1, -(-12 * len(s.word) // total))
        for level in s.levels(5, lambda length, counts, lang, first, local=local: counts >= local):
            found |= set(level.phrases().to_pylist())
    assert {p for _, _, p, *_ in brute.op13([(r[0], r[2]) for r in rows], 12, 10**6)} <= found


@pytest.mark.parametrize("most", [400, 10**6])
def test_no_occurrence_is_named_and_counted(monkeypatch, most):
    """The counting pass gives only what the shards had too little of to name; nothing where their support is one."""
    from types import SimpleNamespace

    import pyarrow as pa

    rows = [(r[0] or "und", r[2]) for r in telling()]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["lang", "text"])
    monkeypatch.setattr(phrases, "CHUNK", 500)
    sizes = Counter()
    for shard in phrases._shards(iter([batch]), most):
        sizes.update(dict(zip(shard.names.to_pylist(), shard.sizes.tolist())))
    every = SimpleNamespace(value=np.full(phrases.BITS >> 6, 2**64 - 1, np.uint64))
    want = {(lang, p): a for lang, _, p, a, *_ in brute.op13(rows, 12, 10**6)}
    for support, silent in ((12, False), (1, True)):
        named, counted = Counter(), Counter()
        sent = SimpleNamespace(value=sizes)
        for got in phrases._mine(support, most, sent, every, None, (2, 5))(iter([batch])):
            named.update({(r["lang"], r["phrase"]): r["n"] for r in got.to_pylist() if r["phrase"] is not None})
        n = 0
        for got in phrases._count(support, most, sent, every, every)(iter([batch])):
            n += got.num_rows
            counted.update({(r["lang"], r["phrase"]): r["n"] for r in got.to_pylist()})
        assert want and {k: named[k] + counted[k] for k in want} == want
        assert n == 0 if silent else n > 0


def test_rows_in_another_order_at_each_reading(spark):
    """Shards are the same in the mining and the counting passes."""

    def shuffled(batches):
        for batch in batches:
            order = list(range(batch.num_rows))
            random.SystemRandom().shuffle(order)
            yield batch.take(order)

    rows = telling()
    docs = table(spark, rows).coalesce(1)
    docs = docs.mapInArrow(shuffled, docs.schema)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "150")
    try:
        got = results(phrases.collocations(docs, 12, 300))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == brute.op13([(lang, t) for lang, _, t in rows], 12, 300)


def test_no_phrases(spark):
    assert phrases.collocations(table(spark, [("a", "b", "c")]).filter("false")).count() == 0
    assert phrases.collocations(table(spark, [("a", "b", "one two"), ("a", None, None)])).count() == 0
