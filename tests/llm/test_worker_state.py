import pyarrow as pa

from sightline.llm.common import process_cache, slices


def test_large_values_go_when_a_worker_takes_up_another_operator():
    made = []
    make = lambda: made.append(1) or len(made)
    assert process_cache("of_test", make, large=True) == process_cache("of_test", make, large=True) == 1
    small = process_cache("of_test_small", object)
    batch = pa.RecordBatch.from_arrays([pa.array(range(5))], ["x"])
    assert [b.num_rows for b in slices([batch, batch], 2)] == [2, 2, 1, 2, 2, 1]
    assert process_cache("of_test", make, large=True) == 2 and process_cache("of_test_small", object) is small
