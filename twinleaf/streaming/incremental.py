"""Clone groups as files arrive: a group is reported when its second instance does, and again with each further one.

State is kept by digest: how many instances there were and the first of them. Subsumption needs the
whole corpus and stays a batch step over what has been written.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

STATE = "n long, file string, start_line int, end_line int"
EMITTED = "hash binary, instance_no long, file string, start_line int, end_line int, node_count int, first_file string, first_start int, first_end int"


def arriving_clones(subtrees: DataFrame, min_node_count: int = 50) -> DataFrame:
    """EMITTED rows of a streaming SUBTREES table: one for each instance after the first of its digest.

    Instances are numbered as they come; those of one Arrow batch by file and place. Batches are taken one at a time, so a digest
    with any number of instances takes the memory of one. State of digests seen once is the size of the
    distinct subtrees; raise min_node_count to bound it.
    """
    columns = [x.split()[0] for x in EMITTED.split(", ")]

    def step(key: tuple, parts: Iterator, state) -> Iterator:
        n, first = 0, None
        if state.exists:
            n, *first = state.get
        for part in parts:
            rows = part.sort_values(["file_ord", "post_ord"], ignore_index=True)
            if rows.empty:
                continue
            if first is None:
                head = rows.iloc[0]
                first = [head["file"], int(head["start_line"]), int(head["end_line"])]
            rows["instance_no"] = rows.index + n + 1
            n += len(rows)
            yield rows.assign(first_file=first[0], first_start=first[1], first_end=first[2]).loc[rows["instance_no"] > 1, columns]
        if first is not None:
            state.update((n, *first))

    big = subtrees.where(f"node_count >= {int(min_node_count)}")
    return big.groupBy("hash").applyInPandasWithState(step, EMITTED, STATE, "append", "NoTimeout")
