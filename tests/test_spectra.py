"""Transforms over shuffles against those of whole channels."""

import numpy as np
import pytest

from assimspark.operators import spectra, truth

LENGTHS = {(1, 0): 4096, (1, 1): 3000, (2, 0): 1009, (2, 1): 1, (3, 0): 2 * 499, (4, 0): 64}


def channels(spark):
    rng = np.random.default_rng(9)
    x = {key: rng.normal(size=n) for key, n in LENGTHS.items()}
    rows = [(s, d, 3 * k + 1, float(v), 1) for (s, d), values in x.items() for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "series_id long, dim int, step long, y double, n int").repartition(5), x


@pytest.mark.parametrize("most,block", [(1 << 20, 256), (100, 700), (1 << 20, 1 << 18)])
def test_transforms_equal_those_of_whole_channels(spark, most, block):
    df, x = channels(spark)
    keys = ["series_id", "dim"]
    rows = spectra.transform(spectra.numbered_channels(df, keys, "y"), keys, most, block).collect()
    assert len(rows) == sum(LENGTHS.values())
    want = {key: np.fft.fft(v) for key, v in x.items()}
    size = {key: abs(w).max() for key, w in want.items()}
    assert all(abs(complex(r["re"], r["im"]) - want[r["series_id"], r["dim"]][r["k"]]) < 1e-9 * size[r["series_id"], r["dim"]] for r in rows)


def test_long_and_short_channels_give_the_same(spark):
    df, _ = channels(spark)
    as_dict = lambda rows, *k: {tuple(r[c] for c in k): r for r in rows}
    short, longer = (as_dict(truth.amplitude_spectrum(df, 0.1, most=most).collect(), "series_id", "dim", "bin") for most in (1 << 20, 200))
    assert short.keys() == longer.keys() and len(short) == sum(n // 2 for n in LENGTHS.values())
    assert all(np.isclose(short[k]["amplitude"], longer[k]["amplitude"], atol=1e-10) and np.isclose(short[k]["frequency"], longer[k]["frequency"]) for k in short)
    named = df.withColumnRenamed("y", "y_true")
    for colour, additive in (("pink", True), ("violet", False)):
        short, longer = (as_dict(truth.add_coloured_noise(named, 0.2, colour, additive=additive, seed=4, most=most).collect(), "series_id", "dim", "step") for most in (1 << 20, 200))
        assert short.keys() == longer.keys() and all(np.isclose(short[k]["y_raw"], longer[k]["y_raw"], atol=1e-9) and short[k]["n"] == longer[k]["n"] for k in short)


def test_no_rows(spark):
    df, _ = channels(spark)
    keys = ["series_id", "dim"]
    assert spectra.transform(spectra.numbered_channels(df.where("step < 0"), keys, "y"), keys).count() == 0
