"""Many literal terms at once: one automaton over all of them reads each text once, however many terms there are."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms of a caller's list, which goes to every task.
MOST = 10_000


def terms_of(df: DataFrame, column: str) -> list[str]:
    """The distinct non-empty terms of a caller's list; a list of more than MOST rows is refused."""
    rows = df.select(column).where(F.col(column).isNotNull() & (F.col(column) != "")).distinct().limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a list of more than {MOST} terms")
    return sorted(r[0] for r in rows)


def literal_hits(df: DataFrame, keep: list[str], text: str, terms: list[str]) -> DataFrame:
    """(keep, term, n, first): for each text and term that it holds, its occurrences (from the left, not overlapping one another) and the place of the first, from 1 in code points. Null texts hold nothing.

    The terms are an Aho-Corasick automaton, built once a task; the work is linear in the text and its hits."""
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for t in terms:
            automaton.add_word(t, t)
        automaton.make_automaton()
        for batch in batches:
            who, term, n, first = [], [], [], []
            for i, x in enumerate(batch.column(len(keep)).to_pylist()):
                seen: dict[str, list[int]] = {}  # term: occurrences, first place, end of the last
                for end, t in automaton.iter(x) if x and terms else ():
                    start = end - len(t) + 1
                    if t not in seen:
                        seen[t] = [1, start + 1, end]
                    elif start > seen[t][2]:
                        seen[t][0] += 1
                        seen[t][2] = end
                for t, (k, at, _) in seen.items():
                    who.append(i)
                    term.append(t)
                    n.append(k)
                    first.append(at)
            at = pa.array(who, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(len(keep))), pa.array(term, pa.string()), pa.array(n, pa.int64()), pa.array(first, pa.int32())], [*keep, "term", "n", "first"])

    return df.select(*keep, F.col(text).alias("_text")).mapInArrow(run, f"{fields}term string, n long, first int")
