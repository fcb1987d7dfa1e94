from textloom.operators import corpus
from textloom.plans import chat


def test_question_to_context(spark):
    docs = spark.createDataFrame([(i, f"học phí {i}", "ptit/", ["hoc_phi", "2024"], 2024, [1.0, i / 10], None) for i in range(5)], "id int, content string, school string, tags array<string>, year int, embedding array<float>, source_date string")
    asked, rows = chat.answer_context(docs, "học phí ptit 2024?", "id", lambda t: [1.0, 0.0], lambda t: "REWRITE: x\nHYDE: y", lambda q, ts: ",".join("5" if i < 2 else "1" for i in range(len(ts))))
    assert (asked.intent, asked.school, asked.tags, asked.year, asked.limit) == ("UNKNOWN", "ptit", ["hoc_phi"], 2024, 10)
    assert [r.id for r in rows.collect()] == [0, 1] and rows.first().enriched == "[Thời gian: 2024] [Loại: Học phí] [Nội dung: học phí 0]"
    assert chat.answer_context(docs, "xin chào", "id", lambda t: [1.0, 0.0])[1] is None
    assert chat.school_name("neu") == "Đại học Kinh tế Quốc dân" and chat.schools(spark).count() == 8


def test_folder_counts(spark):
    files = spark.createDataFrame([("a/b/1",), ("a/b/2",), ("c",)], "path string")
    assert {tuple(r) for r in corpus.folder_counts(files).collect()} == {("a/b", 2), ("", 1)}
