from pyspark.sql import functions as F

from scrubline.llm import decontam as D

SF = "/root/testdata/sf0.01"
ITEM = "Yesterday Anna bought 12 kg of apples, then Anna gave Bob 3 kg of them and kept the rest for the market."


def test_template(spark):
    df = spark.createDataFrame([("In  May Anna ran 5 km, then\n10 MILES. The end (42) x",)], "t string")
    got = df.select(D.template(D.spaced(F.col("t"))).alias("t")).first().t
    assert got == "in <name> <name> ran <num> <unit> then <num> <unit> the end <num> x"


def run(spark, texts, items):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    return {r.doc_id: r["items"] for r in D.decontaminate(docs, bench).collect()}


def test_reparameterised_and_inconsistent(spark):
    swapped = ITEM.replace("Anna", "Clara").replace("Bob", "Dan").replace("12", "30").replace("3 kg", "7 kg")
    broken = swapped.replace("then Clara", "then Emil")  # one name became two
    merged = swapped.replace("Dan", "Clara")             # two names became one
    pad = "some words that stand here before it "
    got = run(spark, [ITEM, "x " + swapped, pad + broken, pad + merged, None, "", "Nothing here", pad * 200 + swapped + pad * 300, ITEM],
              [ITEM, None, "", "too short to take part", ITEM])
    assert got == {0: [0, 4], 1: [0, 4], 2: [], 3: [], 4: [], 5: [], 6: [], 7: [0, 4], 8: [0, 4]}


def test_every_offset_is_caught(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota"
    got = run(spark, ["w " * k + item + " tail" for k in range(6)], [item])
    assert all(v == [0] for v in got.values())


def test_capital_or_changed_word_at_every_offset(spark):
    item = "What is the capital of the largest european country"
    got = run(spark, ["w " * k + item + " tail" for k in range(11)], [item])
    assert all(v == [0] for v in got.values())
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    got = run(spark, ["w " * k + long.replace("iota", "x") + " tail" for k in range(6)], [long])
    assert all(v == [0] for v in got.values())


def test_long_passage_and_shifted_copy(spark):
    words = [f"w{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}" for k in range(60)]
    item = " ".join(words)
    passage = " ".join(words[15:28])
    put_in = " ".join([*words[:12], "x", *words[12:24], "y", *words[24:36], "z", *words[36:48]])  # 32 of 56 windows
    assert len(set(words)) == 60
    got = run(spark, ["a b " + passage + " c", "a " + " ".join(words[15:27]) + " c", put_in], [item])
    assert got == {0: [0], 1: [], 2: [0]}
    half = " ".join(words[:20])  # 16 windows; each side of the added word has 6 and 2 of them
    got = run(spark, [" ".join([*words[:10], "x", *words[10:16]]), " ".join([*words[:10], "x"])], [half])
    assert got == {0: [0], 1: []}


def test_short_items(spark):
    items = ["What is 12 times 7 plus 5?", "Name the capital of Norway", "12 30 9", "Why not", ""]
    got = run(spark, [items[0], "and so I ask What is 30 times 8 plus 2? Well", "what is 12 times 12 plus 5?", "a b Name the capital of Peru now",
                      "a b Clara the capital of Peru now", "1 2 3", "x 12 30 9 y", "So why not", "nothing"], items)
    assert got == {0: [0], 1: [0], 2: [], 3: [1], 4: [], 5: [], 6: [2], 7: [3], 8: []}


def test_edges(spark):
    docs = spark.createDataFrame([(1, ITEM, "a"), (None, ITEM, None)], "doc_id long, text string, items string")
    bench = spark.createDataFrame([(7, ITEM)], "item_id long, text string")
    assert [r["items"] for r in D.decontaminate(docs, bench).collect()] == [[7], [7]]
    assert [r.leaked for r in D.decontaminate(docs, bench.limit(0)).collect()] == [False, False]
    assert D.decontaminate(docs.limit(0), bench).count() == 0


def test_query_and_oracle(spark):
    from tools.oracle_check import check
    assert check(spark, SF, ["op9_decontaminate"])["op9_decontaminate"]["match"]
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = {k for k, t in docs.items() if any(" ".join(i.split()) in " ".join(t.split()) for i in items)}
    got = {r.doc_id for r in D.op9_decontaminate(spark, SF).where("leaked").collect()}
    assert whole and whole <= got and len(got) <= len(whole) + 2
