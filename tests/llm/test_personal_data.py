"""Personal data among tokens that look like numbers."""

import pytest

from parchmint.llm import pii


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.mark.parametrize("token", ["1.2.3.²", "1.2.3.①", "²1.2.3.4", "1.2.3.٣"])
def test_personal_data_odd_digits(spark, docs, token):
    assert pii.features(token, pii.tokens(token))[0, 3:5].tolist() == [0, 0]
    df = docs.select("doc_id", "text").limit(20).union(spark.createDataFrame([(-1, f"at {token} or a@b.example"), (-2, "ip 1.2.3.4")], "doc_id long, text string"))
    got = {r["doc_id"]: r for r in pii.find_personal_data(df, pii.fit(df)).collect()}
    assert len(got) == 22 and got[-1]["n_email"] == 1 and got[-2]["base"] == "ip:3:10"
