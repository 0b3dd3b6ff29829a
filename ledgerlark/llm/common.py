"""Reading tables and passing Arrow batches in and out of tasks."""

import numpy as np
import pyarrow as pa

_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_schema(ddl):
    """The Arrow schema of a plain list "name type, ..."."""
    fields = [field.split() for field in ddl.split(", ")]
    return pa.schema([(name, _TYPES[kind]) for name, kind in fields])


def batch(schema, *columns):
    return pa.RecordBatch.from_arrays([pa.array(column, type=field.type) for column, field in zip(columns, schema)], schema=schema)


def batch_of_rows(schema, rows):
    return batch(schema, *(zip(*rows) if rows else [[] for _ in schema]))


#: Rows of a piece of a record batch that is worked on at once.
PIECE_ROWS = 512


def pieces(batches, rows=PIECE_ROWS):
    """Record batches in small pieces: what a map makes of whole texts on the way is then a
    few megabytes, however many rows the engine puts in a batch."""
    for records in batches:
        for at in range(0, records.num_rows, rows):
            yield records.slice(at, rows)


def lists(record_batch, *names):
    """Columns as Python lists, whatever their order in the batch."""
    return [record_batch.column(record_batch.schema.get_field_index(name)).to_pylist() for name in names]


def groups(batches, keys, columns):
    """Runs of rows with equal ``keys`` (numbers without nulls), whatever the batch they
    come in: (key, table of ``columns``). The partition must be sorted by the keys, and
    its groups bounded."""
    held, held_key = [], None
    for records in batches:
        if not records.num_rows:
            continue
        wanted = pa.Table.from_batches([records])
        stacked = np.stack([wanted.column(name).to_numpy() for name in keys])
        starts = np.concatenate([[0], 1 + np.flatnonzero((stacked[:, 1:] != stacked[:, :-1]).any(axis=0)), [records.num_rows]])
        for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist()):
            key = tuple(stacked[:, start].tolist())
            if key != held_key and held:
                yield held_key, pa.concat_tables(held)
                held = []
            held_key = key
            held.append(wanted.select(columns).slice(start, stop - start))
    if held:
        yield held_key, pa.concat_tables(held)


def matrix(column, dtype=None):
    """A list column whose lists have one length, as rows of a matrix."""
    chunk = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = chunk.flatten().to_numpy(zero_copy_only=False)
    values = values.reshape(len(chunk), -1) if len(chunk) else values.reshape(0, 0)
    return values if dtype is None else values.astype(dtype)
