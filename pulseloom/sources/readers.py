"""Readers of waveform files into rows (record_id, channel, idx, v), of RR files, of results and of configurations.

All read through Spark's own readers, so paths may lie in any store it knows.
"""

from __future__ import annotations

import datetime
import json
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLES = "record_id string, channel string, block int, idx long, v double"
#: Samples of an output batch.
CHUNK = 500_000
#: Fixed values of the Embla format: record numbers, end of the signature, mark of big-endian files.
VERSION, RATE_ERROR, HEADER, TIME, CHANNEL, FREQUENCY, GAIN, NAME, SUBJECT, DATA = 0x80, 0x8A, 0x81, 0x84, 0x85, 0x86, 0x87, 0x90, 0xD0, 0x20
END_OF_SIGNATURE, SIGNATURE, BIG = b"\x1a", "Embla data file", 0xFF


def _batches(record: str, channel: str, block: int, values: np.ndarray):
    for a in range(0, max(len(values), 1), CHUNK):
        part = values[a : a + CHUNK]
        n = len(part)
        yield pa.RecordBatch.from_arrays([pa.array([record] * n, pa.string()), pa.array([channel] * n, pa.string()), pa.array(np.full(n, block), pa.int32()), pa.array(np.arange(a, a + n)), pa.array(np.asarray(part, float))], ["record_id", "channel", "block", "idx", "v"])


def parse_header(text: str) -> dict:
    """A WFDB header: {name, fs, n, signals: [{file, format, gain, baseline, units, name}]}."""
    lines = [x.split("#")[0].strip() for x in text.splitlines()]
    lines = [x for x in lines if x]
    first = lines[0].split()
    fs = float(first[2].split("/")[0]) if len(first) > 2 else 250.0
    signals = []
    for line in lines[1 : 1 + int(first[1])]:
        f = line.split()
        gain, units, base = 200.0, "mV", None
        if len(f) > 2:
            amount, _, units = f[2].partition("/")
            number, _, rest = amount.partition("(")
            gain, base = float(number or 200) or 200.0, int(rest.rstrip(")")) if rest else None
        zero = int(f[4]) if len(f) > 4 else 0
        signals.append({"file": f[0], "format": int(f[1].split("x")[0].split(":")[0].split("+")[0]), "gain": gain, "baseline": zero if base is None else base, "units": units or "mV", "name": " ".join(f[8:]) or f"sig{len(signals)}"})
    return {"name": first[0].split("/")[0], "fs": fs, "n": int(first[3]) if len(first) > 3 else None, "signals": signals}


def decode_signals(raw: bytes, code: int, count: int) -> np.ndarray:
    """(samples, count) of a data file in format 16, 212 or 80."""
    if code == 16:
        flat = np.frombuffer(raw, "<i2", len(raw) // 2).astype(np.int32)
    elif code == 80:
        flat = np.frombuffer(raw, np.uint8).astype(np.int32) - 128
    elif code == 212:
        b = np.frombuffer(raw, np.uint8, len(raw) // 3 * 3).reshape(-1, 3).astype(np.int32)
        flat = np.stack([b[:, 0] | (b[:, 1] & 0x0F) << 8, b[:, 2] | (b[:, 1] & 0xF0) << 4], 1).ravel()
        flat = np.where(flat > 2047, flat - 4096, flat)
    else:
        raise ValueError(f"data format {code} is not supported")
    return flat[: len(flat) // count * count].reshape(-1, count)


def read_wfdb(spark: SparkSession, path: str, channels: int | None = 1) -> DataFrame:
    """Physical samples of all records below ``path`` (a .hea and its .dat), the first ``channels`` signals of each (None: all)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{hea,dat}").load(path)
    stem = F.regexp_replace("path", r"\.(hea|dat)$", "")
    pairs = files.select(stem.alias("stem"), F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).alias("kind"), "content")
    both = pairs.where("kind = 'hea'").select("stem", F.col("content").alias("head")).join(pairs.where("kind = 'dat'").select("stem", F.col("content").alias("data")), "stem")

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                head = parse_header(r["head"].decode("latin-1"))
                table = decode_signals(r["data"], head["signals"][0]["format"], len(head["signals"]))[: head["n"] or None]
                for i, s in enumerate(head["signals"][:channels]):
                    yield from _batches(head["name"], s["name"], 0, (table[:, i] - s["baseline"]) / s["gain"])

    return both.select("head", "data").mapInArrow(run, SAMPLES)


def parse_embla(raw: bytes, only_header: bool = False) -> tuple[dict, list[np.ndarray]]:
    """(header, data blocks) of an Embla file. Byte order counts for the samples too."""
    end = raw[:80].find(END_OF_SIGNATURE)
    if end < 0 or SIGNATURE not in raw[:end].decode("cp1252"):
        raise ValueError("not an Embla data file")
    order, at = (">" if raw[end + 1] == BIG else "<"), end + 2
    if raw[at : at + 5] == b"\xff" * 5:
        at += 31
    head: dict = {"starttime": [], "stoptime": [], "length": []}
    blocks = []
    take = lambda kind, where: struct.unpack_from(order + kind, raw, where)[0]
    text = lambda a, n: raw[a : a + n].decode("cp1252").strip("\x00")
    while at + 8 <= len(raw):
        number, size = take("L", at), take("l", at + 4)
        at += 8
        if number == VERSION:
            head["fileversion"] = raw[at + 1] + 0.01 * raw[at]
        elif number == TIME:
            month, day, hour, minute, second, hundredth = raw[at + 2 : at + 8]
            head["starttime"].append(datetime.datetime(take("h", at), month, day, hour, minute, second, hundredth * 10000))
        elif number == CHANNEL:
            head["channel"] = take("h", at)
        elif number == FREQUENCY:
            head["frequency"] = take("L", at) / 1000
        elif number == RATE_ERROR:
            head["sec_error"] = take("d", at)
        elif number == GAIN:
            head["unitgain"] = take("l", at) * 1e-9
        elif number in (SUBJECT, HEADER, NAME):
            head[{SUBJECT: "subjectinfo", HEADER: "extra", NAME: "channelname"}[number]] = text(at, size)
        elif number == DATA:
            if not only_header:
                blocks.append(np.frombuffer(raw, order + "i2", size // 2, at) * head.get("unitgain", 1.0))
            head["length"].append(size // 2)
            if head["starttime"] and head.get("frequency"):
                head["stoptime"].append(head["starttime"][-1] + datetime.timedelta(seconds=size / 2 / head["frequency"]))
        at += size
    if len(head["stoptime"]) > 1:
        head["interrupt length"] = [int((b - a).total_seconds()) for a, b in zip(head["starttime"], head["stoptime"])]
    return head, blocks


def read_embla(spark: SparkSession, path: str) -> DataFrame:
    """Samples of all .ebm files below ``path``: the file's stem is the record, its blocks are numbered."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ebm").load(path)

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                head, blocks = parse_embla(r["content"])
                for i, values in enumerate(blocks):
                    yield from _batches(r["stem"], head.get("channelname", ""), i, values)

    return files.select(F.regexp_extract("path", r"([^/]*)\.ebm$", 1).alias("stem"), "content").mapInArrow(run, SAMPLES)


def read_embla_headers(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, channel, block, starttime, stoptime, length, sec_error, frequency) of all .ebm files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ebm").load(path)

    def run(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                h, _ = parse_embla(r["content"], True)
                rows += [{"record_id": r["stem"], "channel": h.get("channelname", ""), "block": i, "starttime": a, "stoptime": b, "length": n, "sec_error": h.get("sec_error"), "frequency": h.get("frequency")} for i, (a, b, n) in enumerate(zip(h["starttime"], h["stoptime"], h["length"]))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("record_id", pa.string()), ("channel", pa.string()), ("block", pa.int32()), ("starttime", pa.timestamp("us")), ("stoptime", pa.timestamp("us")), ("length", pa.int64()), ("sec_error", pa.float64()), ("frequency", pa.float64())]))

    return files.select(F.regexp_extract("path", r"([^/]*)\.ebm$", 1).alias("stem"), "content").mapInArrow(run, "record_id string, channel string, block int, starttime timestamp_ntz, stoptime timestamp_ntz, length long, sec_error double, frequency double")


def read_rr(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, start, freq, rposition, marker) of RR files: a head of name=value lines, a dashed line, a tab table.

    Dates may run year first or day first.
    """
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]*?)(\.\w+)?$", 1).alias("record_id"), F.col("value"))
    parts = text.select("record_id", F.regexp_extract("value", r"(?s)\A(.*?)\n-[^\n]*\n(.*)\z", 1).alias("head"), F.regexp_extract("value", r"(?s)\A(.*?)\n-[^\n]*\n(.*)\z", 2).alias("body"))
    lines = F.split("head", "\r?\n")
    value = lambda i: F.trim(F.split_part(lines[i], F.lit("="), F.lit(2)))
    n = F.regexp_extract_all(F.concat_ws(" ", value(2), value(3)), F.lit(r"(\d+)"), 1)
    year_first = F.length(n[0]) == 4
    start = F.to_timestamp_ntz(F.concat(F.concat_ws("-", F.when(year_first, n[0]).otherwise(n[2]), F.lpad(n[1], 2, "0"), F.lpad(F.when(year_first, n[2]).otherwise(n[0]), 2, "0")), F.lit(" "), F.concat_ws(":", F.lpad(n[3], 2, "0"), F.lpad(n[4], 2, "0"), F.lpad(n[5], 2, "0"))), F.lit("yyyy-MM-dd HH:mm:ss"))
    rows = parts.select("record_id", start.alias("start"), value(4).cast("int").alias("freq"), F.explode(F.filter(F.split("body", "\r?\n"), lambda x: F.trim(x) != "")).alias("line"))
    return rows.select("record_id", "start", "freq", F.split_part("line", F.lit("\t"), F.lit(1)).cast("long").alias("rposition"), F.nullif(F.split_part("line", F.lit("\t"), F.lit(2)), F.lit("")).alias("marker"))


#: Columns of section tables written as text by earlier engines.
LEGACY = "wave_section int, start_point int, end_point int, valid int, fail_reason string, Avg_HR float, SDNN float, min_HR_diff float, max_HR_diff float, RMSSD float, NN50 float, PNN50 float, isoelectric float, Avg_QRS float, Avg_QT float, Avg_PR float, Avg_ST float"


def read_legacy_sections(spark: SparkSession, path: str) -> DataFrame:
    """Section rows of CSV results: declared types, absent trailing columns and missing numbers as 0."""
    return spark.read.schema(LEGACY).option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", "true").csv(path).na.fill(0)


def read_channels(spark: SparkSession, path: str, label: str = "ShockClass", time: str = "Time") -> tuple[DataFrame, DataFrame]:
    """(samples, outcomes) of a wide table of channels: (channel, idx, v) by its row order column, and its label."""
    wide = spark.read.parquet(path)
    rows = wide.withColumn("idx", F.row_number().over(Window.partitionBy(*(["pig_id"] if "pig_id" in wide.columns else [])).orderBy(time)) - 1)
    names = [c for c in wide.columns if c not in (label, time, "pig_id", "idx")]
    keys = [c for c in ("pig_id",) if c in wide.columns]
    samples = rows.select(*keys, "idx", F.explode(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).cast("double").alias("v")) for c in names])).alias("_")).select(*keys, "_.channel", F.col("idx").cast("long").alias("idx"), "_.v")
    return samples, rows.select(*keys, F.col("idx").cast("long").alias("idx"), label) if label in wide.columns else rows.select(*keys, "idx").limit(0)


def newest_run(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the latest run_ts below a results path."""
    rows = spark.read.parquet(path)
    return rows.join(F.broadcast(rows.agg(F.max("run_ts").alias("run_ts"))), "run_ts")


DISCORDS = "record_id STRING, section_idx INT, hr INT, rmssd DOUBLE, m INT, discord_index BIGINT, discord_score DOUBLE, wasserstein_metric DOUBLE"


def read_json_results(spark: SparkSession, path: str, schema: str = DISCORDS) -> DataFrame:
    """Rows of JSON results (one object a line, or one array a file); fields that are missing are null."""
    return spark.read.schema(schema).option("multiLine", "false").json(path)


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names below a path: folders first, letters in either case alike, without hidden ones."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    rows = [(not s.isDirectory(), s.getPath().getName()) for s in found]
    return [n for _, n in sorted(rows, key=lambda x: (x[0], x[1].lower())) if not n.startswith(".")]


def load_config(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def parse_log(lines: DataFrame) -> DataFrame:
    """(time, level, name, message) of |-separated log lines."""
    part = lambda i: F.trim(F.split_part("value", F.lit("|"), F.lit(i)))
    return lines.select(part(1).alias("time"), part(2).alias("level"), part(3).alias("name"), part(4).alias("message"))
