"""The derived records are built in bounded pieces."""

import numpy as np
import pyarrow as pa

from checks import synthetic


def _parameters(rows: int, leads: list[str]) -> pa.StructArray:
    k = np.arange(rows)
    own = {
        "k": k, "period": 60 + k * 7 % 60, "af": k % 5 == 0, "p_amp": np.full(rows, 0.15), "q_amp": np.full(rows, -0.1),
        "r_sigma": np.full(rows, 1.2), "t_amp": np.full(rows, 0.3), "noise": k % 10 * 0.01, "drift": np.zeros(rows), "fwave": np.zeros(rows),
    }
    own |= {f"{kind}_{l}": np.full(rows, v) for l in leads for kind, v in (("gain", 1.0), ("shift", 0.25))}
    return pa.StructArray.from_arrays([pa.array(v) for v in own.values()], names=list(own))


def test_a_batch_of_parameters_leaves_in_pieces_with_the_same_samples():
    leads = ["II", "V1", "V6"]
    p, build = _parameters(1500, leads), synthetic._sample_builder(leads).func
    pieces = list(build(iter([p])))
    assert sum(map(len, pieces)) == len(p)
    assert max(len(x) * synthetic.N * len(leads) for x in pieces) <= synthetic.BATCH_SAMPLES
    whole = pa.concat_arrays(pieces)
    for at in (0, 348, 349, 350, 1499):
        assert whole.slice(at, 1).to_pylist() == next(build(iter([p.slice(at, 1)]))).to_pylist()


def test_no_parameters_give_no_samples():
    assert not list(synthetic._sample_builder(["II"]).func(iter([_parameters(0, ["II"])])))
