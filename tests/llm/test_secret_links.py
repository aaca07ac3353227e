"""Parts of one credential on either side of a long span."""

from ledgerspark.llm import secrets


def test_partners_after_a_long_endpoint_are_linked(spark):
    url = "https://h.test/" + "ab.cd." * 200
    docs = [(1, f"{url} login: someone1 password: hunter22x"), (2, f"{url} {'word ' * 90} login: someone1 password: hunter22x")]
    rows = {r.doc_id: r.spans for r in secrets.find_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert f"endpoint:0:{len(url)}" in rows[1] and "identifier" in rows[1]
    assert "endpoint" not in rows[2] and "identifier" in rows[2]
