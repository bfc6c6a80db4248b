import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i // 977}" for i in range(9_000))
BODY = " ".join(f"alpha{i} beta{i}" for i in range(60))


def messy_documents():
    """Rows with nulls, empty, long, tied and repeated texts."""
    near = BODY.replace("alpha7 ", "gamma ")
    return [
        (1, BODY, "en", "a", 1), (2, BODY, "en", "a", 1), (3, near, "en", "b", 1), (4, None, None, None, None), (5, "", "de", "b", 0),
        (6, " \t\n ", "de", None, 4), (7, LONG, "en", "c", 1), (8, "one two three", "en", "c", 3), (9, "one two three", "fr", "c", 3),
        (10, "mail a.b@c.example.org or +1 (743) 555-3824, 4465 7583 8288 9437 x 4111 1111 1111 1111 1.2.3.4 1.2.3.400 a@b.c_d@e.f", "en", "a", 1),
        (10, "mail a.b@c.example.org or +1 (743) 555-3824, 4465 7583 8288 9437 x 4111 1111 1111 1111 1.2.3.4 1.2.3.400 a@b.c_d@e.f", "en", "a", 1),
        (None, BODY, "en", "a", 1), (None, "null id " + BODY[:300], "en", "a", 1), (11, "### " * 200, "en", "a", 1), (12, "naïve 🎉 ça va " * 40, "fr", "b", 1),
        (13, "Repeat this line\nRepeat this line\n" * 30, "en", "b", 1),
    ]


DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, _size string, `kept` int, word string, _h string, _copies string, target string, _set string, _sig string, _n string, _c string, _q_w string, _q_kept string, _p_all string, _p_marks string, c0 string"
#: Values of the columns that follow n_chars, in every row.
EXTRA = ("x", "y", 7, None, *[f"own {k}" for k in range(12)])


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """(folder of messy tables, folder of empty tables); documents carry extra columns with clashing names."""
    full, empty = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("empty")
    docs = [(*r, *EXTRA) for r in messy_documents()]
    good = [(i, f"clean words number {i} " + " ".join(f"v{i}u{j}" for j in range(70)), "en", "a", 9, *EXTRA) for i in range(100, 700)]
    bad = [(i, " ".join(f"s{i}#{j}" for j in range(70)), "en", "a", 9, *EXTRA) for i in range(700, 800)]
    conversations = [(1, 0, "system", "be kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "héllo 🎉"), (1, 2, "assistant", "héllo 🎉"), (2, 0, None, None), (2, 1, "user", ""), (None, 0, "user", "x"), (3, 0, "system", "alone")]
    pages = [(1, "http://a/é b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (None, "u", "<p>x</p>"), (None, None, "<p>only</p>"), (2, "again", "<p>x</p>"), (9, "u", "<div>é🎉" + "long " * 50_000)]
    e = [float(i % 7) - 3 for i in range(16)]
    tilt = [x + 0.01 * i for i, x in enumerate(e)]
    vectors = [(1, e, 1), (2, e, 1), (3, tilt, 1), (4, e, 2), (5, e, None), (6, None, 1), (7, [0.0] * 16, 1), (8, [float("nan")] * 16, 1), (9, [*e[:15], None], 1), (10, [2 * x for x in e], 1), (None, e, 1), (2, e, 1), (11, [-x for x in e], 1), (12, e[:8], 1), (13, [], 1)]
    data = {
        "documents": (docs + good + bad, DOC_SCHEMA),
        "labels": ([(i, int(i < 700), 0) for i in range(100, 800)] + [(None, 1, 0), (100, None, 0), (12345, 1, 0)], "doc_id long, quality int, toxic int"),
        "conversations": (conversations, "conv_id long, turn long, role string, text string"),
        "pages": (pages, "page_id long, url string, html string"),
        "embeddings": (vectors, "vec_id long, embedding array<float>, label int"),
    }
    for name, (rows, schema) in data.items():
        df = spark.createDataFrame(rows, schema)
        if name != "documents":  # columns that clash with those the operators work with
            for c in ("_sha", "_to", "rep", "keys", "speaker", "perspective", "segment", "q", "payload", "n_links"):
                df = df.withColumn(c, F.lit("own"))
        df.repartition(3).write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{empty}/{name}.parquet")
    return str(full), str(empty)
