import random

from skuforge.operators import similarity


def test_copies_against_all_pairs(spark):
    draw = random.Random(8)
    docs = spark.createDataFrame([(i, " ".join(draw.choice(("hot", "cold", "bolt", "ring", "plate")) for _ in range(draw.randint(0, 3))), draw.choice("ab")) for i in range(150)], "id long, text string, category string")
    want = similarity.top_similar(similarity.weights(docs, "id", "text"), "id", docs.select("id", "category"), k=3)
    got = similarity.top_similar_copies(docs, "id", "text", "category", k=3)
    assert got.columns == ["id", "other", "score", "rank"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("id", "other", "score", "rank").collect()))


def test_bounds_against_all_pairs(spark):
    draw = random.Random(9)
    words = ["hot", "cold", "bolt", "ring", "plate"] + [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(draw.choices(words, [20] * 5 + [1] * 60, k=draw.randint(0, 6))), draw.choice("ab")) for i in range(220)]
    docs += [(1000 + i, "bolt w1 w2", "a") for i in range(9)] + [(2000, None, "a"), (2001, "Bolt W1 w2", None)]
    docs = spark.createDataFrame(docs, "id long, text string, category string")
    for k, least in ((3, 0.12), (5, 0.4)):
        want = similarity.top_similar(similarity.weights(docs, "id", "text"), "id", docs.select("id", "category"), k=k, least=least)
        got = similarity.top_similar_bounded(docs, "id", "text", "category", k=k, least=least)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("id", "other", "score", "rank").collect()))
    assert similarity.top_similar_bounded(docs.limit(0), "id", "text", "category").count() == 0


def test_meetings_grow_less_than_quadratically_where_all_texts_differ(spark):
    def met(n):
        draw = random.Random(n)
        texts = [f"{draw.choice(('steel', 'brass'))} {draw.choice(('bolt', 'ring', 'plate'))} for {draw.choice(('home', 'farm'))} m{draw.randrange(n // 8)} x{draw.randrange(n // 8)} u{i}" for i in range(n)]
        w = similarity.weights(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").selectExpr("'c' AS category", "id", "term", "weight")
        vectors = similarity.bounded_vectors(w).cache()
        limits = similarity.first_limits(vectors, 5, 6).cache()
        rows = similarity.meetings(vectors, limits, 0.12, 1e-6).count()
        every = vectors.alias("a").join(vectors.selectExpr("term", "id AS other"), "term").filter("id <> other").count()
        return rows, every

    small, large = met(500), met(2000)
    assert large[1] > 12 * small[1]
    assert large[0] < 8 * small[0] and large[0] < large[1] / 10, (small, large)
