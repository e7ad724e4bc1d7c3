"""A hot template (more than a third of all lines) must not change results
or need an unbounded group."""

import random

from conftest import lines_df

from logweave.operators.ingest import ingest
from logweave.operators.prompts import sample_lines
from logweave.plans.analyze import cluster_entries


def test_hot_template(spark):
    r = random.Random(2)
    lines = []
    for i in range(30_000):
        if i % 3 == 0 or r.random() < 0.05:
            msg = f"Connection refused to db-{r.randrange(999)}:{r.randrange(9999)}"  # one template
        else:
            msg = r.choice(["Disk usage at {}% on /var", "User {} logged in", "Job {} finished in {}ms",
                            "Cache miss for key {}"]).format(r.randrange(1000), r.randrange(1000))
        lines.append(f"2024-01-15 10:{i // 600 % 60:02d}:{i % 60:02d} ERROR svc{i % 7} - {msg}")
    df = lines_df(spark, lines).repartition(12)
    c = cluster_entries(ingest(df))
    sizes = sorted((r.size for r in c.clusters.collect()), reverse=True)
    hot = sum(1 for l in lines if "Connection refused" in l)
    assert sizes[0] == hot and hot > len(lines) // 3
    assert sum(sizes) == len(lines)
    s = sample_lines(c.assigned).where("cluster_no = 1").orderBy("n").collect()
    assert [x.n for x in s] == list(range(1, 21))
    assert [x.line_no for x in s] == sorted(i + 1 for i, l in enumerate(lines) if "Connection refused" in l)[:20]
