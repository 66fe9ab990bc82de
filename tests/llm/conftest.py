from __future__ import annotations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

DOCUMENTS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()), ("score", pa.float64()), ("spans", pa.string()), ("component", pa.int64())])


@pytest.fixture
def folder(tmp_path):
    """Writes documents (with further columns of clashing names) and other tables, and gives their folder."""

    def write(documents=None, **tables):
        if documents is not None:
            rows = [(i, t, "en", None, None, 0.5, "x", 3) for i, t in documents]
            columns = list(zip(*rows, strict=True)) or [[]] * len(DOCUMENTS)
            pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, DOCUMENTS, strict=True)], schema=DOCUMENTS), tmp_path / "documents.parquet")
        for name, table in tables.items():
            pq.write_table(table, tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write
