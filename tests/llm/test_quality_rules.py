import re

from pyspark.sql import functions as F

from longloom.llm import quality_rules as q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
TEXTS = [None, "", " \n\t ", "one", "a b c a b c", "x y x y x y x", "a b c\na b c\n\n a b c\nd", "été # $ à|b <c>",
         "the same words again. the same words again.\nthe same words again.", "w " * 400, "é" * 70 + "\x0b z\r\nq"]


def measures(text):
    words = WORDS.findall(text or "")
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_measures(spark):
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    rows = docs.select("text", q.text_measures(F.col("text")).alias("m")).collect()
    for r in rows:
        assert tuple(r["m"]) == measures(r["text"]), r["text"]


LINES = [("A line of prose that ends well.", False), ("A line of prose that stops", True), ("Two words", False),
         ("Home | News | About | Contact.", True), ("Read our privacy policy here.", True), ("", False), ("   ", False),
         ("costs $5 and $6 & more.", True), ("He said: “yes.”", False), ("Une phrase normale, très longue…", False)]


def test_lines(spark):
    text = "\n".join(t for t, _ in LINES)
    row = spark.createDataFrame([(text,)], "text string").select(q.clean_lines(F.col("text")).alias("c")).first()["c"]
    assert row["text"].split("\n") == [t for t, bad in LINES if not bad]
    assert row["lost_lines"] == sum(bad for _, bad in LINES)
    assert row["kept_words"] == sum(len(WORDS.findall(t)) for t, bad in LINES if not bad)


def test_documents(spark):
    prose = "\n".join(f"This is line number {i} of {i * 7}{'abcdefghijkl'[i]} new {i}x things." for i in range(12))
    menu = "\n".join(f"Home{i} | News{i} | About{i} | Contact{i} | Login{i}" for i in range(12))
    docs = spark.createDataFrame(
        [(1, prose, "k"), (1, prose, "k"), (2, menu, None), (3, prose + "\n" + "Home | News | More", "k"), (4, "short.", "k"),
         (5, "again and again. " * 60, "k"), (None, None, None)], "doc_id long, text string, kept string")
    rows = q.apply_quality_rules(docs).orderBy("doc_id").collect()
    got = [(r["doc_id"], r["quality"]["base_failed"], r["quality"]["kept"]) for r in rows]
    assert got == [(None, True, False), (1, False, True), (1, False, True), (2, False, False), (3, False, True),
                   (4, True, False), (5, True, False)]
    assert rows[4]["quality"]["text"] == prose and rows[4]["kept"] == "k"
    assert q.apply_quality_rules(docs.filter("doc_id = 99")).count() == 0


def test_no_python_and_no_shuffle(spark, capsys):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q.apply_quality_rules(docs).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
