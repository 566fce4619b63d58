import random

from tracewell.operators import batches


def brute(rows, k, hops):
    """Lists of what each batch may see, followed hop by hop."""
    ends = sorted((b, t, e, side, *((x, y) if side == 0 else (y, x))) for b, t, e, x, y in rows for side in (0, 1))
    out = set()
    for batch in {r[0] for r in rows}:
        known = {}
        for b, *_, node, other in ends:
            if b < batch and node is not None:
                known.setdefault(node, []).append(other)
        for start in {n for b, _, _, x, y in rows if b == batch for n in (x, y)} - {None}:
            at = {start}
            for hop in range(1, hops + 1):
                at = {x for n in at for x in known.get(n, [])[-k:]}
                out |= {(batch, start, x, hop) for x in at}
    return out


def made(n, nodes, far):
    random.seed(5)
    pick = lambda: None if random.random() < 0.02 else int(random.paretovariate(0.7)) % nodes
    return [(i // 4 * (far if i > n // 2 else 1), i // 3 * 10**12, i, pick(), pick()) for i in range(n)]


def test_hops_equal_brute_force(spark):
    """Batches far apart, null ends, hot nodes; slices of one batch, of a few, of all."""
    rows = made(160, 30, 3)
    edges = spark.createDataFrame(rows, "batch long, t long, event_id long, src long, dst long")
    for k, hops, width in ((2, 2, 1 << 16), (2, 2, 3), (3, 3, 1), (1, 2, 7)):
        got = [tuple(r) for r in batches.last_neighbours_hops(edges, k, hops, width).select("batch", "node", "neighbour", "hop").collect()]
        assert len(got) == len(set(got)) and set(got) == brute(rows, k, hops)


def test_two_hops_take_few_jobs(spark):
    """Every shuffle of the search is a job or more."""
    edges = spark.createDataFrame([r for r in made(400, 50, 1) if None not in r], "batch long, t long, event_id long, src long, dst long")
    spark.sparkContext.setJobGroup("hops", "two hops")
    try:
        batches.last_neighbours_hops(edges, 2, 2).write.format("noop").mode("overwrite").save()
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("hops")) < 24
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
