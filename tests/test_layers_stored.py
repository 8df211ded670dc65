"""Features that later sums go over are stored as their SQL stores them."""

from loomgraph.operators import candidates as C
from loomgraph.operators import features as X
from loomgraph.operators import window as W


def test_readings_of_the_layers_are_stored_to_six_digits(spark):
    pairs = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 2), (1, 6), (6, 7)]
    e = spark.createDataFrame([(k, a, b, 500 + k, 10.0 + k, "x", 0) for k, (a, b) in enumerate(pairs)], "seq long, src long, dst long, t long, amount double, channel string, label int")
    registry = spark.createDataFrame([(k, "A", 1, "e", "t") for k in range(8)], "key long, country string, bank long, entity_id string, entity_type string")
    p = W.pairs(W.live(W.islands(e)))
    cand = spark.createDataFrame([(780, "1,2,3,4,5,6,7", 1, [1, 2, 3, 4, 5, 6, 7], 7)], "now long, key string, seed long, nodes array<long>, size int")
    own = cand.selectExpr("now", "seed", "explode(nodes) node")
    inner = C.induced(own, p)
    plain, got = C.layers(inner).first(), X.build(cand, own, inner, p, e, registry).first()
    assert plain.gargaml != round(plain.gargaml, 6)
    assert (got.gargaml, got.bipartite, got.stack) == (round(plain.gargaml, 6), round(plain.bipartite, 6), round(plain.stack, 6))
