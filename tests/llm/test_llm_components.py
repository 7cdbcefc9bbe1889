import random

from llm_cases import classes

from evalspark.llm.components import connected_components, path_ends


def test_components_of_paths_stars_and_random_links(spark):
    rng = random.Random(1)
    ids = rng.sample(range(10**9), 120)
    links = [(ids[i], ids[i + 1]) for i in range(40)] + [(ids[50], x) for x in ids[51:80]]
    links += [(rng.choice(ids[80:]), rng.choice(ids[80:])) for _ in range(20)] + [(7, 7), (None, 3)]
    both = {(a, b) for a, b in links} | {(b, a) for a, b in links}
    nodes = {x for a, b in links for x in (a, b) if a != b and None not in (a, b)}
    got = connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == classes(nodes, lambda a, b: (a, b) in both)
    assert len(got) == len(nodes)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_path_ends(spark):
    ids = random.Random(2).sample(range(10**9), 50)
    steps = [(ids[i], ids[i + 1]) for i in range(39)] + [(ids[45], ids[46])]
    got = {r.node: r["last"] for r in path_ends(spark.createDataFrame(steps, "a long, b long")).collect()}
    assert got == {**{ids[i]: ids[39] for i in range(39)}, ids[45]: ids[46]}
