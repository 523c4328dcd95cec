"""Records cut in parallel: quoted line breaks in CSV, arrays in JSON, over borders of blocks."""

from __future__ import annotations

import csv
import io
import json
import random

import pytest

from millrace.sources import records, tables


@pytest.fixture
def small_blocks(spark):
    """Blocks of some hundred bytes, so that records run over borders."""
    keys = {"spark.sql.files.maxPartitionBytes": "301", "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def values(seed: int, n: int) -> list[dict]:
    rng = random.Random(seed)
    texts = ["plain", 'a "quoted" word', "two\nlines", "x,y", '"', "\\", '\\"', "{", "}", "]}", "[{", "é\u2028ü", "tail\\", " , ", "a\n\n\nb", 'z",\n"w']
    return [{"id": k, "text": "".join(rng.choice(texts) for _ in range(rng.randrange(1, 6))), "n": rng.randrange(1000)} for k in range(n)]


def csv_text(rows: list[dict], end: str = "\n") -> str:
    out = io.StringIO()
    writer = csv.DictWriter(out, ["id", "text", "n"], lineterminator=end)
    writer.writeheader()
    writer.writerows(rows)
    return out.getvalue()


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_with_line_breaks(spark, tmp_path, small_blocks, end):
    rows = values(1, 150) + [{"id": 150, "text": "long " * 300 + "\nover blocks\n" + "x" * 900, "n": 1}]
    for name, part in (("a.csv", rows[:100]), ("b.csv", rows[100:])):
        (tmp_path / name).write_text(csv_text(part, end), newline="")
    df = tables.read_csv(spark, str(tmp_path))
    assert df.columns == ["id", "text", "n"] and dict(df.dtypes)["id"] == "bigint"
    assert sorted((r.id, r.text, r.n) for r in df.collect()) == [(r["id"], r["text"], r["n"]) for r in rows]


def test_csv_is_cut_in_many_tasks_and_in_file_order(spark, tmp_path, small_blocks):
    rows = values(2, 120)
    (tmp_path / "a.csv").write_text(csv_text(rows))
    grammar = records.csv_grammar()
    assert records._pieces(spark, str(tmp_path), grammar).rdd.getNumPartitions() >= 8
    found = records.cut(spark, str(tmp_path), grammar).orderBy("file", "block", "place").collect()
    assert "".join(r.text for r in found) == csv_text(rows) and len(found) == 121


def test_csv_with_a_long_header_and_blank_lines(spark, tmp_path, small_blocks):
    (tmp_path / "a.csv").write_text("\n" * 700 + '"id","' + "long\nname " * 80 + '"\n\n1,x\n')
    (tmp_path / "b.csv").write_text('id,other\n2,"y\n"\n')
    df = tables.read_csv(spark, str(tmp_path))
    assert df.columns == ["id", "long\nname " * 80]
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x"), (2, "y\n")]


def test_csv_without_line_breaks_stays_a_plain_scan(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n1,"a,b"\n2,5" pipe\n3,"say ""hi"""\n')
    df = tables.read_csv(spark, str(tmp_path))
    assert [(r.id, r.t) for r in df.orderBy("id").collect()] == [(1, "a,b"), (2, '5" pipe'), (3, 'say "hi"')]
    assert "FileScan csv" in df._jdf.queryExecution().toString()


def test_csv_separator_odd_quotes_and_odd_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffid;t;t;\n1;"x\ny";6" wide;"z;\n"\n\n2;NA;b;c\n', encoding="utf-8")
    df = tables.read_csv(spark, str(tmp_path), sep=";")
    assert len(df.columns) == 4 and df.columns[0] == "id"
    assert sorted(tuple(r) for r in df.collect()) == [(1, "x\ny", '6" wide', "z;\n"), (2, None, "b", "c")]


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("escape", [True, False])
def test_json_array(spark, tmp_path, small_blocks, indent, escape):
    rows = [{**r, "deep": [{"k": r["text"], "v": [{"w": "}"}, {"w": r["text"][:2]}]}], "none": None if r["id"] % 2 else "]"} for r in values(3, 90)]
    rows[40]["text"] = "over blocks " * 200
    (tmp_path / "a.json").write_text(json.dumps(rows[:60], indent=indent, ensure_ascii=escape), encoding="utf-8")
    (tmp_path / "b.json").write_text("\n " + json.dumps(rows[60:], indent=indent) + "\n\n")
    assert records._pieces(spark, str(tmp_path), records.json_grammar()).rdd.getNumPartitions() >= 8
    found = tables.read_json(spark, str(tmp_path)).orderBy("id").collect()
    assert [json.loads(json.dumps(r.asDict(True))) for r in found] == rows


def test_json_odd_files(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    (tmp_path / "b.json").write_text('{"id": 1, "t": {"x": "}"}}\n{"id": 2}')
    (tmp_path / "c.json").write_text('\ufeff[{"id": 3, "t": {}}]', encoding="utf-8")
    found = tables.load(spark, str(tmp_path), "json")
    assert sorted((r.id, r.t and r.t.x) for r in found.collect()) == [(1, "}"), (2, None), (3, None)]


@pytest.mark.parametrize("grammar", [records.csv_grammar(), records.json_grammar()])
def test_states_compose(grammar):
    """Scanning piece by piece gives the state and depth that character by character scanning gives."""
    rows = values(5, 40)
    text = csv_text(rows) if grammar.separator == "\n" else json.dumps(rows)
    state = depth = 0
    for end, piece in enumerate(text.split(grammar.separator)[:-1]):
        state, change = grammar.scan(piece, state)
        depth += change
        read = grammar.separator.join(text.split(grammar.separator)[:end + 1]) + grammar.separator
        if grammar.separator == "\n":
            assert state == read.count('"') % 2  # every quote of these rows is quoted
        else:
            inside, level, escaped = False, 0, False
            for c in read:
                if inside:
                    inside, escaped = (escaped or c != '"'), c == "\\" and not escaped
                else:
                    inside, level = c == '"', level + (c in "{[") - (c in "}]")
            assert (state, depth) == (int(inside), level)


def test_too_many_blocks(spark, tmp_path, small_blocks, monkeypatch):
    (tmp_path / "a.json").write_text(json.dumps(values(6, 50)))
    monkeypatch.setattr(records, "BLOCKS", 2)
    with pytest.raises(ValueError, match="maxPartitionBytes"):
        tables.read_json(spark, str(tmp_path))


def test_rows_keep_the_order_of_the_files(spark, tmp_path, small_blocks):
    from millrace.operators import validate

    rows = values(7, 200)
    rng = random.Random(3)
    down = sorted((rng.random() for _ in rows), reverse=True)
    for r, d in zip(rows, down):
        r.update(up=r["id"] + 0.5, down=d)
    for part, name in ((rows[:120], "a"), (rows[120:], "b")):
        (tmp_path / f"{name}.json").write_text(json.dumps(part))
        (tmp_path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, part)))
        for kind, kept in (("lines", True), ("plain", False)):
            out = io.StringIO()
            names = ["id", "up", "down", *(["text"] if kept else [])]
            writer = csv.DictWriter(out, names, lineterminator="\n", extrasaction="ignore")
            writer.writeheader()
            writer.writerows(part)
            (tmp_path / kind).mkdir(exist_ok=True)
            (tmp_path / kind / f"{name}.csv").write_text(out.getvalue())
    spark.createDataFrame([(r["id"], r["up"], r["down"]) for r in rows], "id long, up double, down double").coalesce(1).write.parquet(f"{tmp_path}/p.parquet")
    found = [tables.read_json(spark, f"{tmp_path}/*.json"), tables.read_json(spark, f"{tmp_path}/*.jsonl", lines=True),
             tables.read_csv(spark, f"{tmp_path}/lines"), tables.read_csv(spark, f"{tmp_path}/plain"), tables.read_parquet(spark, f"{tmp_path}/p.parquet")]
    for df in found:
        assert validate.id_columns(df, text_ids=False) == [c for c in df.columns if c in ("id", "up")], df.columns
        assert [r.id for r in tables.preview(df, n=3).collect()] == ["0", "1", "2"]
    mixed = found[-1].orderBy("down")
    assert tables.file_order(mixed) is None and validate.id_columns(mixed) == []
    assert tables.file_order(found[-1].filter("id > 3").select("up")) is not None
