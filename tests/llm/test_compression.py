"""Compression bands: base counts against a plain version, each verdict, odd inputs."""

import base64
import random
import re

import pytest
import zstandard
from pyspark.sql import functions as F

from authwatch.llm import compression, queries
from authwatch.llm.compression import Bands
from tests.llm.naive import corpus

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0D]+")


def plain(text):
    """The base counts, by the definitions."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)} if len(words) < 2000 else None
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n_repeat = None if covered is None else len(covered)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, n_repeat


def test_base_counts(spark):
    texts = [t for _, t, *_ in corpus(3, 40)] + [
        "a b c a b c", "a b c d a b c e", "x x x x", "x x x", "one\ttwo\x0bthree\x0cfour\rfive", "é ü   ñ", "a\n\na\n \n \nb\na",
        "#*$%&|<> <b>", "w " * 60 + "end", "same line\n same line\nsame line"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3).select(
        "i", compression.judge(F.col("text")).alias("c")).select("i", "c.*").collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain(texts[r.i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == want[:4], texts[r.i]
        if want[4] is not None:
            assert r.n_repeat_words == want[4], texts[r.i]
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (r.reason is None) and not (r.base_failed and r.kept)


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(5)
    words = ["".join(rng.choice("etaoinshrdlucmfwyp") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    return lambda n: " ".join(rng.choice(words) for _ in range(n))


def verdicts(spark, texts, bands=Bands()):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return {r.i: r for r in rows.select("i", compression.judge(F.col("text"), bands).alias("c")).select("i", "c.*").collect()}


def test_bands(spark, prose):
    rng = random.Random(6)
    noise = " ".join(base64.b64encode(rng.randbytes(60)).decode() for _ in range(400))
    stock = prose(40)
    # differs in one word each time, so that no three words repeat often enough for the rule on words
    alike = " ".join(f"{w}{k}" for k in range(60) for w in stock.split()[:12])
    texts = [prose(80), prose(3000), prose(60_000), noise, prose(4000) + noise, "ab" * 9000 + " " + prose(50), alike, prose(30)]
    got = verdicts(spark, texts)
    assert [got[i].reason for i in range(3)] == [None] * 3 and got[2].n_chunks > 50
    assert got[3].reason == "noise" and got[3].ratio > 0.72
    assert got[4].reason == "noisy_chunks" and not got[4].kept and 0 < got[4].n_noisy_chunks < got[4].n_chunks
    assert got[5].reason == "repetitive" and not got[5].base_failed
    assert got[7].reason == "words"
    # a repetitive stretch in a long text: the whole passes, its chunks don't
    mixed = verdicts(spark, [prose(9000) + " " + "ab" * 12_000])[0]
    assert mixed.reason == "repetitive_chunks" and mixed.ratio > 0.2


def test_ratio_equals_plain_zstandard(spark, prose):
    text = prose(5000)
    raw = text.encode()
    got = verdicts(spark, [text])[0]
    pack = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False).compress
    assert got.ratio == len(pack(raw)) / len(raw)
    whole, chunk = compression.ratios(raw, 4096, zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False))
    starts = list(range(0, len(raw), 4096))
    starts[-1] = len(raw) - 4096
    assert whole == got.ratio and chunk.tolist() == [len(pack(raw[a:a + 4096])) / 4096 for a in starts]
    assert len(compression.ratios(raw[:8192], 4096, zstandard.ZstdCompressor())[1]) == 2


def test_limits_are_parameters(spark, prose):
    strict = Bands(limits=((0, 0.9, 1.0),), least_words=0)
    assert verdicts(spark, [prose(500)], strict)[0].reason == "repetitive"
    assert verdicts(spark, ["", None], strict)[0].kept and verdicts(spark, ["", None], strict)[1].kept


def test_odd_inputs(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "  \n ", None), (None, "a b", "x"), (4, "long " * 300_000, "x"), (4, "long " * 300_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept string")
    got = docs.select("*", compression.judge(F.col("text")).alias("c")).collect()
    assert len(got) == 6 and [r.c.n_words for r in got] == [0, 0, 0, 2, 300_000, 300_000]
    assert got[0].c.ratio is None and got[1].c.ratio is None and got[2].c.ratio is not None
    assert all(r.c.base_failed and r.c.reason == "words" for r in got) and got[4].c == got[5].c
    assert docs.limit(0).select(compression.judge(F.col("text"))).count() == 0


def test_query_keeps_good_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id").distinct()
    got = queries.op11_compression(spark, SF)
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio"]
    good = got.join(labels, "doc_id").where("NOT base_failed")
    assert good.count() > 20 and good.where("NOT kept").count() == 0
