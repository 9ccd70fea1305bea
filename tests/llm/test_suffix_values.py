"""What the tree says of runs: a context's count goes with the context, not with each run after it."""

import numpy as np
import pyarrow as pa

from fidelis.llm import suffix_lm as s


def test_a_context_count_is_sent_once():
    runs = [np.array([3, 3, 4]), np.array([1, 7, 2])]
    names = s.name_of(runs)
    values = {"kind": 6, "level": 2, "b": names[:2].tobytes(), "c": s.pack(np.array([9, 0])), "a": [s.pack(np.array([0, 20]))], "d": np.array([np.nan, 0.5]).tobytes()}
    told = {"kind": 0, "level": 2, "chunk": 5, "a": s.pack_runs(runs)}
    (row,) = [b.to_pylist()[0] for b in s._valued_parts(0, iter([told, values]), s._Out(pa.int64()))]
    assert [x.tolist() for x in s.unpack_runs(row["a"])] == [[3, 3], [1, 7]]
    assert s.unpack(row["b"]).tolist() == [9, 0] and s.unpack(row["c"]).tolist() == [0, 20]
    assert np.array_equal(s.unpack(row["d"], np.float32), np.array([np.nan, 0.5], np.float32), equal_nan=True)
