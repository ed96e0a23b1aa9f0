import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from parlance.functions.identity import alias_key
from parlance.functions.times import archive_moment
from parlance.operators import merge as mg
from parlance.plans.update import archive_rows, merge_into, merge_lines, normalize
from parlance.session import materialize
from parlance.sources import archive as ar
from parlance.sources import identities as ids
from parlance.sources import sinks
from parlance.sources.lines import read_lines
from parlance.sources.raw_export import date_order, parse_export
from parlance.sources.sinks import ARCHIVE
from parlance.streaming.exports import stream_exports

EXPORT = """top of the file
13/12/2024, 14:23 - Alice Smith: first
second line

after a gap

04/08/2024, 14:24 - Bob: hi @⁨Contact⁩ and @923001234567 or mail me@x.com
04/08/2024, 14:25 - Alice changed the group description: hi
04/08/2024, 14:26 - Bob added Carol
[04/08/2024, 2:27:05 PM] ~ Carol: bracketed
2024-08-04 15:00:01 alice smith: plain
31/02/2024, 10:00 - Bob: no such day

"""


@pytest.fixture(scope="module")
def claims(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("ids") / "identities.json"
    path.write_text(json.dumps({"identities": [
        {"name": "Alice", "aliases": ["Alice Smith", "shared"]},
        {"name": "Bob", "aliases": ["923001234567@lid", "Shared"]},
        {"name": "Dana", "aliases": ["Contact"]},
    ]}))
    return ids.alias_claims(ids.read_identities(spark, str(path)))


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("raw") / "a.txt"
    path.write_text(EXPORT, encoding="utf-8")
    return read_lines(spark, str(path))


def test_parse(lines):
    rows = parse_export(lines).orderBy("entry").collect()
    assert [(r.date, r.time, r.sender, r.msg, r.unparsed) for r in rows] == [
        (None, None, None, "top of the file", True),
        ("13-Dec-2024", "14:23", "Alice Smith", "first\nsecond line\n\nafter a gap", False),
        ("04-Aug-2024", "14:24", "Bob", "hi @⁨Contact⁩ and @923001234567 or mail me@x.com", False),
        ("04-Aug-2024", "14:25", None, "Alice changed the group description: hi", False),
        ("04-Aug-2024", "14:26", None, "Bob added Carol", False),
        ("04-Aug-2024", "14:27", "~ Carol", "bracketed", False),
        ("04-Aug-2024", "15:00", "alice smith", "plain", False),
        ("31/02/2024", "10:00", "Bob", "no such day", False),
    ]
    assert rows[7].dt is None and rows[2].dt == dt.datetime(2024, 8, 4, 14, 24)


def test_date_order(spark, tmp_path):
    def verdict(*dates):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.txt"
        path.write_text("".join(f"{d}, 10:00 - A: x\n" for d in dates))
        return date_order(read_lines(spark, str(path))).first().day_first

    assert verdict("13/12/2024", "04/08/2024") is True
    assert verdict("12/13/2024", "04/08/2024") is False
    assert verdict("04/08/2024") is None
    assert verdict("13/12/2024", "12/13/2024") is None
    assert verdict("2024-12-13") is None


def test_normalize(lines, claims):
    rows = normalize(lines, claims).orderBy("entry").collect()
    assert [r.block_text for r in rows] == [
        "[UNPARSED - review this line] top of the file",
        "13-Dec-2024, 14:23 - Alice: first\nsecond line\n\nafter a gap",
        "04-Aug-2024, 14:24 - Bob: hi @Dana and @Bob or mail me@x.com",
        "04-Aug-2024, 14:25 - [SYSTEM] Alice changed the group description: hi",
        "04-Aug-2024, 14:26 - [SYSTEM] Bob added Carol",
        "04-Aug-2024, 14:27 - ~ Carol [UNRESOLVED]: bracketed",
        "04-Aug-2024, 15:00 - Alice: plain",
        "31/02/2024, 10:00 - Bob: no such day",
    ]


def test_alias_keys_and_conflicts(spark, claims):
    labels = spark.createDataFrame([("Mira❤️",), ("mira❤",), ("~ MIRA❤",), ("⁨Mira❤⁩ ",)], "l string")
    assert {r[0] for r in labels.select(alias_key(F.col("l"))).collect()} == {"mira❤"}
    shared = claims.where("alias_key = 'shared'").first()
    assert (shared.canonical, shared.n_claimants) == ("Alice", 2)
    assert ids.alias_conflicts(claims).count() == 1
    assert ids.unambiguous(claims).where("alias_key = 'shared'").count() == 0


def blocks(spark, rows, src):
    """(minute or None, text) pairs as archive rows."""
    data = [(0, i, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(data, "chat_id long, seq long, block_text string")
    first = F.regexp_extract("block_text", ar.BLOCK_LINE, 1), F.regexp_extract("block_text", ar.BLOCK_LINE, 2)
    slot = ar.slot_columns(F.col("block_text"))
    return df.withColumns({"dt": archive_moment(*first), **slot, "src_file": F.lit(src)}).select(*ARCHIVE.names)


def at(minute, text, sender="A"):
    return f"01-Jan-2024, 10:{minute:02d} - {sender}: {text}"


WAIT = "Waiting for this message. This may take a while."


@pytest.mark.parametrize("old, new, want, counts", [
    ([at(1, "x")], [at(2, "y")], [at(1, "x"), at(2, "y")], (1, 0, 0)),
    ([at(1, "x")], [at(1, "x")], [at(1, "x")], (0, 1, 0)),
    ([at(1, "x")], [at(2, "lol"), at(2, "lol")], [at(1, "x"), at(2, "lol"), at(2, "lol")], (2, 0, 0)),
    ([at(1, "ok")], [at(1, "ok"), at(1, "ok")], [at(1, "ok"), at(1, "ok")], (1, 1, 0)),
    ([at(1, "real")], [at(1, WAIT)], [at(1, "real")], (0, 0, 1)),
    ([at(1, "real")], [at(2, WAIT)], [at(1, "real"), at(2, WAIT)], (1, 0, 0)),
    ([at(1, "a"), at(3, "c")], [at(2, "b")], [at(1, "a"), at(2, "b"), at(3, "c")], (1, 0, 0)),
    ([at(1, "a")], ["no date here", at(0, "b")], [at(0, "b"), at(1, "a"), "no date here"], (2, 0, 0)),
    ([at(1, "a")], [at(1, "b")], [at(1, "a"), at(1, "b")], (1, 0, 0)),
])
def test_merge(spark, old, new, want, counts):
    a, b = blocks(spark, old, "old"), blocks(spark, new, "new")
    judged = materialize(mg.judged(a, b, cell_rows=1), "judged")
    assert tuple(mg.verdict_counts(judged).first())[1:] == counts
    once = materialize(mg.merged(a, judged), "once")
    assert [r.block_text for r in once.orderBy("seq").collect()] == want
    assert mg.judged(once, b).where("verdict = 'new'").count() == 0


def test_two_phones_one_archive(spark, claims, tmp_path):
    for name, contact in (("a", "Contact"), ("b", "923001234567")):
        (tmp_path / f"{name}.txt").write_text(f"13/12/2024, 10:00 - Alice Smith: hi\n13/12/2024, 10:01 - {'Bob' if name == 'a' else '~ BOB'}: yes\n", encoding="utf-8")
    root = str(tmp_path / "root")
    for name in ("a", "b", "a"):
        archive = merge_lines(spark, str(tmp_path / f"{name}.txt"), root, claims)
    assert [r.block_text for r in archive.orderBy("seq").collect()] == ["13-Dec-2024, 10:00 - Alice: hi", "13-Dec-2024, 10:01 - Bob: yes"]
    log = spark.read.json(f"{root}/merge_log").orderBy("merged_at").collect()
    assert [(r.added, r.duplicates) for r in log] == [(2, 0), (0, 2), (0, 2)]
    assert all(len(r.sha256) == 64 for r in log)
    assert sinks.current_version(spark, root) == 3


def test_archive_text_round_trip(spark, lines, claims, tmp_path):
    rows = archive_rows(normalize(lines, claims))
    sinks.write_ordered_text(rows, str(tmp_path / "text"))
    back = read_lines(spark, str(tmp_path / "text"))
    assert [r.block_text for r in ar.parse_blocks(back).where("dt IS NOT NULL").orderBy("seq").collect()][0].endswith("after a gap")
    messages = ar.parse_messages(back).orderBy("seq").collect()
    assert [m.is_system for m in messages] == [False, False, True, True, False, False]


def test_big_file_in_many_splits(spark, tmp_path):
    text = "".join(f"2024-01-01 10:{i % 60:02d}:00 P{i % 7}: message {i}\n" + "more\n" * (i % 3) for i in range(3000))
    (tmp_path / "big.txt").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        rows = parse_export(read_lines(spark, str(tmp_path / "big.txt"))).orderBy("entry").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.msg for r in rows] == [f"message {i}" + "\nmore" * (i % 3) for i in range(3000)]


def test_line_separators_do_not_end_a_line(spark, tmp_path):
    (tmp_path / "s.txt").write_text("13/12/2024, 10:00 - A: one\u2028two\n13/12/2024, 10:01 - B: x\u0085y\n\u200e13/12/2024, 10:02 - A: z\u2029\n", encoding="utf-8")
    rows = parse_export(read_lines(spark, str(tmp_path / "s.txt"))).orderBy("entry").collect()
    assert [(r.sender, r.time) for r in rows] == [("A", "10:00"), ("B", "10:01"), ("A", "10:02")]
    assert [r.msg for r in rows][:2] == ["one\u2028two", "x\u0085y"]


def test_log_of_several_files_in_one_call(spark, claims, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text("13/12/2024, 10:00 - Alice Smith: hi\n13/12/2024, 10:01 - Bob: yes\n")
    (tmp_path / "c.txt").write_text("no message here\n13/12/2024, 10:00 - Alice Smith: hi\n")
    root = str(tmp_path / "root")
    merge_lines(spark, str(tmp_path / "*.txt"), root, claims)
    log = {r.file.rsplit("/", 1)[1]: r for r in spark.read.json(f"{root}/merge_log").collect()}
    assert {n: (r.added, r.duplicates) for n, r in log.items()} == {"a.txt": (2, 0), "b.txt": (0, 2), "c.txt": (1, 1)}
    assert log["c.txt"].note == "1 undated row(s) appended at the end"
    assert log["a.txt"].sha256 == log["b.txt"].sha256 != log["c.txt"].sha256


def test_hash_does_not_depend_on_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"line {i}\n" for i in range(20000)))
    whole = sinks.file_hashes(spark, str(tmp_path / "big.txt")).first()["sha256"]
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
    try:
        assert sinks.file_hashes(spark, str(tmp_path / "big.txt")).first()["sha256"] == whole
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    old, none = spark.createDataFrame([], sinks.STORED), spark.createDataFrame([], ARCHIVE)
    sinks.publish_merge(str(tmp_path), old, none)
    monkeypatch.setattr(sinks, "current_version", lambda *_: 0)
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.publish_merge(str(tmp_path), old, none)


def _files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in (root / "parts").rglob("*.parquet")}


def test_a_merge_writes_its_months_alone(spark, tmp_path):
    def day(month, d, text):
        return f"{d:02d}-{month}-2024, 10:00 - A: {text}"

    def texts():
        return [r.block_text for r in sinks.read_archive(spark, str(tmp_path)).orderBy("seq").collect()]

    first = [day("Jan", 1, "a"), day("Jan", 2, "b"), day("Feb", 1, "c"), day("Mar", 1, "d"), "no date"]
    merge_into(spark, str(tmp_path), blocks(spark, first, "one"))
    before = _files(tmp_path)
    assert {f.split("month=")[1].split("/")[0] for f in before} == {"2024-01", "2024-02", "2024-03", "undated"}
    judged = merge_into(spark, str(tmp_path), blocks(spark, [day("Feb", 1, "c"), day("Feb", 1, "c2"), day("Feb", 3, "e"), day("Mar", 1, "d")], "two"))
    assert tuple(mg.verdict_counts(judged).first())[1:] == (2, 2, 0)
    new = {f: t for f, t in _files(tmp_path).items() if f not in before}
    assert new and all("month=2024-02" in f for f in new) and all(_files(tmp_path)[f] == t for f, t in before.items())
    assert texts() == [day("Jan", 1, "a"), day("Jan", 2, "b"), day("Feb", 1, "c"), day("Feb", 1, "c2"), day("Feb", 3, "e"), day("Mar", 1, "d"), "no date"]
    # Nothing new: a version without a new part. The old version is still there to read, until its parts are dropped.
    seen = _files(tmp_path)
    merge_into(spark, str(tmp_path), blocks(spark, first, "three"))
    assert _files(tmp_path) == seen and sinks.current_version(spark, str(tmp_path)) == 3
    assert sinks.read_archive(spark, str(tmp_path), version=1).count() == len(first)
    merge_into(spark, str(tmp_path), blocks(spark, [day("Feb", 9, "f")], "four"))
    want = texts()
    assert sinks.drop_old_parts(spark, str(tmp_path), keep=1) == 2  # the February of the second merge, nothing of the third
    assert texts() == want and len(want) == 8


def test_streamed_batches_write_their_months_alone(spark, claims, tmp_path):
    folder, root = tmp_path / "in", tmp_path / "root"
    folder.mkdir()
    for month in (1, 2, 3):
        (folder / f"{month}.txt").write_text(f"13/{month:02d}/2024, 10:00 - Alice Smith: hi\n14/{month:02d}/2024, 10:01 - Bob: yes\n")
        stream_exports(spark, str(folder), str(root), claims, str(tmp_path / "checkpoint")).awaitTermination()
    months = [f.split("month=")[1].split("/")[0] for f in _files(root)]
    assert sorted(months) == ["2024-01", "2024-02", "2024-03"]
    assert sinks.read_archive(spark, str(root)).count() == 6


@pytest.mark.parametrize("cell_rows", [2, 1 << 17])
def test_copies_over_many_cells(spark, cell_rows):
    """Of n new copies those beyond the archive's count are new, wherever they stand."""
    rng = random.Random(4)
    old = [at(rng.randrange(3), rng.choice("abc")) for _ in range(30)]
    new = [at(rng.randrange(4), rng.choice(["a", "b", "c", WAIT])) for _ in range(60)]
    got = mg.judged(blocks(spark, old, "old"), blocks(spark, new, "new").repartition(3), cell_rows=cell_rows).orderBy("seq").collect()
    left, want = Counter(old), []
    for text in new:
        left[text] -= 1
        taken = WAIT in text and any(text[:18] == o[:18] for o in old)
        want.append("duplicate" if left[text] >= 0 else "placeholder" if taken else "new")
    assert [r.verdict for r in got] == want


def test_rows_without_an_order_column(spark):
    from parlance.sources.tables import from_table

    rows = spark.createDataFrame([(dt.datetime(2024, 1, 1, 9, i % 3), f"P{i % 5}", f"text {i}") for i in range(300)], "at timestamp_ntz, who string, said string")
    got = from_table(rows, "at", "who", "said").orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(300)) and [r.ts for r in got] == sorted(r.ts for r in got)
