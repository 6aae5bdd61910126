import numpy as np
import public_tokenizers
import pytest

from litlens.llm.packing import difference, fill, pack, token_counts

VOCABULARY = str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def test_difference_balances():
    sizes = np.random.default_rng(1).integers(1, 100, 400)
    sums = np.bincount(difference(sizes, 8), weights=sizes, minlength=8)
    assert sums.sum() == sizes.sum() and sums.max() - sums.min() <= 3
    assert difference(np.array([5]), 3).tolist() == [0]


@pytest.mark.parametrize("capacity,low,high", [(256, 1, 256), (1024, 1, 600), (100, 60, 100), (10, 10, 10), (100, 1, 5)])
def test_fill(capacity, low, high):
    sizes = np.random.default_rng(2).integers(low, high + 1, 300)
    label = fill(sizes, capacity)
    sums = np.bincount(label, weights=sizes)
    best = max(-(-sizes.sum() // capacity), (sizes > capacity / 2).sum())
    assert (label >= 0).all() and sums.max() <= capacity and sums.min() > 0 and len(sums) <= best * 1.02 + 1


def test_pack(spark):
    docs = [(i, "word " * (i % 60 + 1)) for i in range(500)] + [(9000, "long text " * 3000), (9001, None), (9002, ""), (9003, "word"), (9003, "word")]
    df = spark.createDataFrame(docs, "tokens long, text string").withColumnRenamed("tokens", "doc")
    sized = {}
    for r in token_counts(df, "doc", "text", VOCABULARY).collect():
        sized[r.id] = sized.get(r.id, 0) + r.tokens
    out = pack(df, "doc", "text", {"small": 64, "large": 1000}, VOCABULARY).toPandas()
    for name, g in out.groupby("target"):
        assert g.groupby("doc").tokens.sum().to_dict() == {k: v for k, v in sized.items() if v}
        assert (g.groupby("window").tokens.sum() <= g.capacity.iat[0]).all()
        whole = [k for k, v in sized.items() if 0 < v <= g.capacity.iat[0] and k != 9003]
        assert (g[g.doc.isin(whole)].groupby("doc").size() == 1).all()
    assert pack(df.limit(0), "doc", "text", {"small": 64}, VOCABULARY).count() == 0 and pack(df, "doc", "text", {}, VOCABULARY).count() == 0
    with pytest.raises(ValueError):
        pack(df, "doc", "text", {"none": 0}, VOCABULARY)
