"""Components of links: right whatever repeats, and with few stages, as each costs the driver memory."""

import random

import numpy as np
import pytest

from larkspur.llm import common, similar
from larkspur.llm.labels import Labels


@pytest.fixture
def stages(spark):
    """The number of stages that ``run`` takes, and what it gives."""

    def count(name, run):
        sc = spark.sparkContext
        sc.setJobGroup(name, name)
        try:
            found = run()
            tracker = sc.statusTracker()
            return sum(len(tracker.getJobInfo(j).stageIds) for j in tracker.getJobIdsForGroup(name)), found
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)

    return count


@pytest.mark.parametrize("seed", range(3))
def test_components_of_links_that_repeat(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(9)] + [(200, i) for i in range(201, 230)]
    links += [(b, a) for a, b in links] + links
    labels = Labels(300)
    labels.link(*np.array(links).T)
    nodes = {x for a, b in links if a != b for x in (a, b)}
    least = {}
    for x in sorted(nodes):
        least.setdefault(labels.of[x], x)
    found = common.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()
    assert sorted((r.node, r.component) for r in found) == [(x, least[labels.of[x]]) for x in sorted(nodes)]


def test_components_take_few_stages(spark, stages):
    for name, links, most in (("stars", [(i % 7, i) for i in range(7, 200)], 10), ("chain", [(i, i + 1) for i in range(300)], 160)):
        df = spark.createDataFrame(links, "a bigint, b bigint")
        took, rows = stages(f"components of {name}", lambda df=df: common.components(df).count())
        assert rows == len({x for link in links for x in link}) and took <= most


def test_similar_takes_few_stages(spark, stages, odd):
    """A pipeline's driver keeps something of every stage: 211 tasks of each on the check's hot tables."""
    took, rows = stages("similar", lambda: similar.groups(odd.select("doc_id", "text")).count())
    assert rows == odd.count() and took <= 150
