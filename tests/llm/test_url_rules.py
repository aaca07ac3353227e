"""Mined URL rules when most labelled pages are bad."""

from ledgerspark.llm import urlrules


def test_sure_rules_are_kept_at_a_high_share_of_bad_pages(spark):
    pages = spark.createDataFrame([(n, f"https://x.test/{'spam' if n < 12 else 'fine'}/{n}") for n in range(20)], "page_id long, url string")
    labels = spark.createDataFrame([(n, int(n >= 12), 0) for n in range(20)], "doc_id long, quality int, toxic int")
    rows = {r.page_id: r for r in urlrules.judge(pages, labels).collect()}
    assert {n for n, r in rows.items() if r.verdict == "block"} == set(range(12))
    assert rows[0].mined == "path=spam" and rows[0].confidence == 1.0
