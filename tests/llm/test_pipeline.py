"""The pipeline's stages on odd documents, each against brute force where there is one."""

import collections
import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from larkspur.llm import common, mixing, similar, simhash
from larkspur.llm.labels import Labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, odd):
    """A table folder with the odd documents and labels for some."""
    path = str(tmp_path_factory.mktemp("tables"))
    odd.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i * 3, int(i % 7 > 0), 0) for i in range(80)], "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages_keep_columns_and_run_on(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = docs.columns
    for at, (_, stage) in enumerate(pipeline.STAGES):
        docs = stage(spark, docs, folder).cache()
        assert docs.count() > 0
        if at < len(pipeline.STAGES) - 1:
            assert docs.columns == names
    assert pipeline.run(spark, folder).count() == docs.count()


@pytest.mark.parametrize("at", range(5))
def test_stages_take_empty_tables_and_extra_columns(spark, folder, odd, none, at):
    stage = pipeline.STAGES[at][1]
    assert stage(spark, none, folder).count() == 0
    found = stage(spark, odd, folder)
    assert found.count() > 0
    if at < 4:
        assert found.columns == odd.columns


def test_line_stage_keeps_rows(spark, folder, odd):
    found = pipeline.line_stage(spark, odd, folder)
    assert found.count() == odd.count()
    assert found.where("text IS NOT NULL AND length(text) <> n_chars").count() == 0


def test_near_stage_keeps_one_of_each_group(spark, folder, odd):
    groups = simhash.near_duplicates(odd).select("component").distinct().count()
    found = pipeline.near_stage(spark, odd, folder)
    assert found.count() == groups
    assert simhash.near_duplicates(found).groupBy("component").count().where("count > 1").count() == 0


def test_mix_stage_takes_what_the_mix_says(spark, folder, odd):
    found = pipeline.mix_stage(spark, odd, folder)
    drawn = collections.Counter()
    for r in found.select("source", "text").collect():
        drawn[r.source] += len(WORD.findall(r.text))
    wanted = collections.Counter()
    sized = odd.select("doc_id", mixing.size(F.col("text")).alias("size"), "source", F.xxhash64("text").alias("tag"))
    for r in mixing.taken(sized).collect():
        wanted[r.mix_key] += r.taken
    assert {("1" if k is None else f"0{k}"): v for k, v in drawn.items()} == {k: v for k, v in wanted.items() if v}
    whole = {r.text for r in odd.select("text").collect()}
    assert sum(r.text not in whole for r in found.select("text").collect()) <= len(wanted)


def test_similar_stage_takes_all_of_similarity(spark, folder, odd_rows):
    rng = random.Random(8)
    texts = [r[1] for r in odd_rows]
    base = [str(rng.randrange(10**6)) for _ in range(200)]
    texts += [" ".join("new" if i in changed else w for i, w in enumerate(base)) for changed in (rng.sample(range(200), rng.randrange(9)) for _ in range(120))]
    texts += [" ".join(base[:60] + [str(rng.randrange(10**6)) for _ in range(rng.randrange(10, 90))]) for _ in range(60)]  # one passage
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    sets = []
    for t in texts:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    labels = Labels(len(texts))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    labels.link(*np.array(pairs).T)
    wanted = {min(i for i in range(len(texts)) if labels.of[i] == c) for c in set(labels.of.tolist())}
    stage = dict(pipeline.STAGES)["SimHash near-dedup"]
    assert {r.doc_id for r in stage(spark, docs, folder).select("doc_id").collect()} == wanted


@pytest.fixture
def kept(monkeypatch):
    """The tables that are kept from here on: name, table."""
    found, keep = [], common.keep

    def noted(df, name, *args, **options):
        found.append((name, keep(df, name, *args, **options)))
        return found[-1][1]

    monkeypatch.setattr(common, "keep", noted)
    return found


def random_text(rng, n):
    return " ".join(str(rng.randrange(10**6)) for _ in range(n))


def test_similar_keeps_less_than_the_texts(spark, kept):
    """No table holds the sets of all documents; these are larger than the texts."""
    rng = random.Random(9)
    texts = [random_text(rng, 1000) for _ in range(60)]
    texts.append(texts[0] + " more")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert similar.groups(docs).select("component").distinct().count() == 60
    size = sum(Path(f.removeprefix("file:").replace("//", "/")).stat().st_size for _, df in kept for f in df.inputFiles() if df.count())
    assert size < sum(map(len, texts)) / 2


def test_simhash_classes_leave_the_join(spark, kept):
    """What is shared only inside a class that SimHash finds isn't looked at again; links between classes are found."""
    rng = random.Random(10)
    base = random_text(rng, 3000).split()
    copies = [" ".join("new" if i == at else w for i, w in enumerate(base)) for at in range(100, 1300, 200)]
    docs = spark.createDataFrame(list(enumerate(copies)), "doc_id bigint, text string")
    assert simhash.near_duplicates(docs, shingle=similar.SHINGLE).select("component").distinct().count() == 1
    assert similar.groups(docs).select("component").distinct().count() == 1
    assert [df.count() for name, df in kept if name == "shared-rows"] == [0]

    # chains of a similarity of about 0.82, which SimHash leaves apart
    chain = [base]
    for at in range(5):
        chain.append([f"{at} {i}" if i % 50 == at else w for i, w in enumerate(chain[-1])])
    docs = spark.createDataFrame(list(enumerate([*copies, *map(" ".join, chain[1:]), random_text(rng, 50)])), "doc_id bigint, text string")
    assert simhash.near_duplicates(docs, shingle=similar.SHINGLE).select("component").distinct().count() > 3
    assert sorted(r["count"] for r in similar.groups(docs).groupBy("component").count().collect()) == [1, 11]


def test_promising_pairs_lose_no_link(spark):
    """What first shingles leave out is never alike, whatever the sizes; alike pairs stay."""
    rng, sets = random.Random(11), {}
    pool = list(range(1, 60))
    for tag in range(150):
        sets[tag] = sorted(rng.sample(pool, rng.randrange(1, 59)) if tag % 3 else rng.sample(pool[: 5 + tag % 20], 5))
    firsts = {t: x[: len(x) - similar._rest(len(x))] for t, x in sets.items()}
    rows = spark.createDataFrame([(k, t, len(sets[t])) for t, x in firsts.items() for k in x], "key bigint, tag bigint, n int")
    pairs = [(a, b) for a in sets for b in range(a) if set(firsts[a]) & set(firsts[b])]
    alike = {(a, b) for a, b in ((a, b) for a in sets for b in range(a)) if 5 * len(set(sets[a]) & set(sets[b])) >= 4 * len(set(sets[a]) | set(sets[b]))}
    found = {(r.a, r.b) for r in similar._promising(spark.createDataFrame(pairs, "a bigint, b bigint"), rows).collect()}
    assert alike and alike <= found and len(found) < len(pairs)
