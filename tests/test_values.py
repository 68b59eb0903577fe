"""Golden values and small fixtures in the shape of the real logs."""

import json
import random
import struct
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from screenwell import schemas
from screenwell.functions import columns as C
from screenwell.functions import fingerprints as fp
from screenwell.functions.quasi import halton, radical_inverse
from screenwell.operators import ledger as L
from screenwell.sources import files, records, sinks


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], names) if names else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_ordinals(spark):
    want = {1: "1st", 2: "2nd", 3: "3rd", 4: "4th", 11: "11th", 12: "12th", 13: "13th", 21: "21st", 111: "111th", 122: "122nd"}
    df = spark.createDataFrame([(n,) for n in want], "n long")
    assert {r["n"]: r["o"] for r in df.select("n", C.ordinal("n").alias("o")).collect()} == want


def test_affinity(spark):
    assert one(spark, C.to_affinity("s"), s=0.0174) == -0.522
    assert one(spark, C.is_hit(F.lit(None).cast("double"), F.lit(-1.0))) is False


def test_radical_inverse(spark):
    assert abs(one(spark, radical_inverse("i", 3), i=6) - 2 / 9) < 1e-15
    assert one(spark, halton("i", 0), i=0) == 0.5
    assert one(spark, radical_inverse("i", 2), i=2 ** 53 + 1) == 0.5 + 2.0 ** -54
    for base in (2, 3, 17):
        i, want, scale = 2 ** 63 - 5, 0.0, 1 / base
        while i:
            want, scale, i = want + scale * (i % base), scale / base, i // base
        assert abs(one(spark, radical_inverse("i", base), i=2 ** 63 - 5) - want) < 1e-12


@pytest.mark.parametrize("smiles,want,ok", [
    ("CCO", {"C", "O"}, True), ("c1ccccc1Br", {"C", "Br"}, True), ("CB(O)O", {"C", "B", "O"}, False),
    ("C[Se]C", {"C", "Se"}, False), ("CSC", {"C", "S"}, True), ("[nH]1cccc1", {"N", "C"}, True),
    ("[Na+].[Cl-]", {"Na", "Cl"}, False), ("C*", {"C", "*"}, False), ("c1cc[se]c1", {"C", "Se"}, False),
    ("[13CH3]I", {"C", "I"}, True), ("OP(=O)O", {"O", "P"}, False), ("", set(), False)])
def test_elements(spark, smiles, want, ok):
    df = spark.createDataFrame([(smiles,)], "s string")
    row = df.select(C.elements("s").alias("e"), C.no_banned("s").alias("ok")).first()
    assert (set(row["e"]), row["ok"]) == (want, ok)


@pytest.mark.parametrize("text", ["", "abc", "abcd", "naïve café", "a😀bc😀d", "x" * 50 + "\n\ty"])
def test_qgrams(spark, text):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(fp.qgrams("s", 4).alias("g")).first()["g"] == [text[i:i + 4] for i in range(len(text) - 3)]


def test_bit_text_round_trip(spark):
    rnd = random.Random(0)
    rows = [(sorted(rnd.sample(range(2048), k)),) for k in (0, 1, 60, 2048)]
    df = spark.createDataFrame(rows, "b array<int>").withColumn("t", fp.array_to_bits("b", 2048))
    for r in df.select("b", "t", fp.bits_to_array("t").alias("back"), fp.pack_words("b", 2048).alias("w")).collect():
        assert len(r["t"]) == 2048 and r["back"] == r["b"]
        assert sum((w & (2 ** 64 - 1)).bit_count() for w in r["w"]) == len(r["b"])


def test_tanimoto_of_empty_sets(spark):
    df = spark.createDataFrame([([], [], 0)], "a array<int>, b array<int>, w long")
    assert df.select(fp.tanimoto("a", "b"), fp.tanimoto_word("w", "w")).first()[:] == (None, None)


# --- rewards ---------------------------------------------------------------------------------------

def test_example_reward():
    assert Decimal(25) * Decimal("0.50") * Decimal("0.75") == Decimal("9.375")


@pytest.mark.parametrize("how", [{}, {"group_rows": 0, "partitions": 4}])
def test_halving_walk(spark, how):
    rnd = random.Random(9)
    rows = [(i, rnd.choice("ab"), rnd.choice([1, 5, 25])) for i in range(2600)]
    steps, cap = [Decimal(3000), Decimal(5000), Decimal(6000)], Decimal(6500)
    df = spark.createDataFrame(rows, "i long, t string, base int")
    got = {r["i"]: r for r in L.halved_rewards(df, ["i"], "t", F.col("base"), steps, cap, **how).collect()}
    minted, seen = Decimal(0), {}
    for i, t, base in rows:
        n = seen.get(t, 0)
        seen[t] = n + 1
        full = base * (Decimal("0.5") if n >= 1000 else Decimal("0.75") if n >= 100 else Decimal(1))
        rate = Decimal(1) / 2 ** sum(minted > s for s in steps)
        reward = min(full * rate, cap - minted)
        assert got[i]["reward"] == round(reward, 6), i
        minted += reward
    assert minted == cap


@pytest.mark.parametrize("n,factor", [(0, "1.00"), (99, "1.00"), (100, "0.75"), (999, "0.75"), (1000, "0.50")])
def test_hit_tiers(spark, n, factor):
    assert one(spark, L.hit_multiplier("n"), n=n) == Decimal(factor)


# --- files -----------------------------------------------------------------------------------------

def test_log_with_odd_lines(spark, tmp_path):
    lines = [{"ts": 1.5, "target_id": "EGFR", "boltz_score": 0.2, "source": "ref"},
             {"ts": 2, "target_id": "EGFR", "boltz_score": "0.3", "gpu": 1}, {"ts": "x", "target_id": None}]
    text = "\n".join([json.dumps(lines[0]), "{broken", "", json.dumps(lines[1]), json.dumps(lines[2])])
    (tmp_path / "log.jsonl").write_text(text)
    rows = files.read_log(spark, str(tmp_path / "log.jsonl")).collect()
    assert [(r["ts"], r["boltz_score"], r["gpu"]) for r in rows] == [(1.5, "0.2", None), (2.0, "0.3", 1), (None, None, None)]
    bad = files.read_log(spark, str(tmp_path / "log.jsonl"), keep_malformed=True).filter(F.col(files.CORRUPT).isNotNull())
    assert bad.select("ts", files.CORRUPT).collect()[0][files.CORRUPT] == "{broken"


def test_smi_files_by_name(spark, tmp_path):
    for name, body in {"AAAA.smi": "smiles zinc_id\nCCO Z1\n\nCCN Z2\n", "AAAC.smi": "CCC Z3\n", "BBAB.smi": "CCCC\n"}.items():
        (tmp_path / name).write_text(body)
    got = files.read_smi(spark, str(tmp_path), last_letters="AB", tranches=["AA"]).collect()
    assert sorted((r["smiles"], r["tranche"]) for r in got) == [("CCN", "AAAA"), ("CCO", "AAAA")]


def test_fasta_and_alignment(spark, tmp_path):
    (tmp_path / "P1.a3m").write_text(">query\nMK->L\nAA\x00\n>hit1\nM-\n>hit2 x\r\nMK\r\n")
    rows = sorted(map(tuple, files.read_a3m(spark, str(tmp_path)).collect()))
    assert rows == [("P1", 0, "query", "MK->LAA"), ("P1", 1, "hit1", "M-"), ("P1", 2, "hit2 x", "MK")]
    assert files.read_fasta(spark, str(tmp_path)).count() == 3


def test_alignment_split_over_tasks(spark, tmp_path):
    body = "".join(f">s{i}\n{'MK' * 20}\n" for i in range(500))
    (tmp_path / "P2.a3m").write_text(body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = files.read_a3m(spark, str(tmp_path), group_rows=0, partitions=4).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r["pos"]: r["header"] for r in rows} == {i: f"s{i}" for i in range(500)}


def test_merge_alignments(spark):
    def side(rows):
        return spark.createDataFrame(rows, "uniprot_id string, pos int, header string, sequence string")
    a = side([("P", 0, "query", "MK"), ("P", 1, "a1", "M")])
    b = side([("P", 0, "query", "MK"), ("P", 1, "b1", "K"), ("Q", 0, "query", "L")])
    got = sorted((r["uniprot_id"], r["pos"], r["header"]) for r in files.merge_msa(a, b).collect())
    assert got == [("P", 0, "query"), ("P", 1, "a1"), ("P", 2, "b1"), ("Q", 0, "query")]
    b = side([("P", 0, "b0", "MK"), ("P", 1, "101", "K")])
    got = sorted((r["uniprot_id"], r["pos"], r["header"]) for r in files.merge_msa(a, b).collect())
    assert got == [("P", 0, "query"), ("P", 1, "a1"), ("P", 2, "b0"), ("P", 3, "101")]
    b = side([("P", 0, "query", "MK"), ("P", 1, "101", "K")])
    assert files.merge_msa(a, b).count() == 2


def test_telemetry(spark):
    lines = ["120.5, 99, 61, 1024, 24576, NVIDIA RTX, Ti", "[N/A], 1, 2, 3, 4, X", "", "75 W, 1, 2, 3, 4, Y"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    got = [(r["name"], r["power_draw"], r["memory_total"]) for r in files.parse_telemetry(df).collect()]
    assert got == [("NVIDIA RTX, Ti", 120.5, 24576.0), ("Y", 75.0, 4.0)]


def test_every_layout_decodes(spark):
    rnd = random.Random(4)
    for name, layout in schemas.LAYOUTS.items():
        blob, want = bytes(range(8)), {}
        for f, kind in layout:
            if kind == "f32":
                v = struct.unpack("<f", struct.pack("<f", rnd.uniform(-50, 50)))[0]
                raw = struct.pack("<f", v)
            elif kind.startswith("enum"):
                v, raw = kind[4:].split("|")[1], b"\x01"
            elif kind == "bool":
                v, raw = True, b"\x01"
            elif kind == "i64":
                v = -rnd.randrange(1 << 60)
                raw = struct.pack("<q", v)
            elif kind.startswith("keys"):
                raw = bytes(rnd.randrange(256) for _ in range(160))
                v = [raw[i:i + 32] for i in range(0, 160, 32)]
            elif kind.startswith("bytes"):
                v = raw = bytes(rnd.randrange(256) for _ in range(int(kind[5:])))
            else:
                size = records.width_of(kind)
                v = (1 << (8 * size)) - 1 - rnd.randrange(100)
                raw = v.to_bytes(size, "little")
            if f == "smiles":
                raw, v = b"CCO".ljust(512, b"\0"), "CCO"
            if f == "smiles_len":
                raw, v = b"\x03\x00", 3
            blob += raw
            want[f] = v
        df = spark.createDataFrame([(bytearray(blob),), (bytearray(blob[:-1]),)], "data binary")
        got = records.decode_records(df, "data", name, bytes(range(8))).collect()
        assert len(got) == 1
        for f, v in want.items():
            have = got[0][f]
            have = [bytes(x) for x in have] if isinstance(have, list) else bytes(have) if isinstance(have, bytearray) else have
            assert have == v, (name, f)


@pytest.mark.parametrize("bits", [0x00000000, 0x80000000, 0x00000001, 0x7F800000, 0xFF800000, 0x3F800000, 0x7F7FFFFF])
def test_float_edges(spark, bits):
    df = spark.createDataFrame([(bytearray(struct.pack("<I", bits)),)], "d binary")
    assert df.select(records.float32(F.col("d"), 0).alias("x")).first()["x"] == struct.unpack("<f", struct.pack("<I", bits))[0]


def test_snapshot_may_read_itself(spark, tmp_path):
    root = str(tmp_path / "s")
    sinks.write_snapshot(spark.range(3), root)
    sinks.write_snapshot(sinks.read_snapshot(spark, root).withColumn("id", F.col("id") + 10), root)
    assert sorted(r["id"] for r in sinks.read_snapshot(spark, root).collect()) == [10, 11, 12]


def test_registry_keeps_first(spark):
    old = spark.createDataFrame([("a", 1)], "smiles string, n int")
    new = spark.createDataFrame([(" a ", 2), ("b", 4), (" b", 3), ("  ", 9)], "smiles string, n int")
    assert sorted(map(tuple, sinks.register_new(old, new, "smiles", ["n"]).collect())) == [("a", 1), ("b", 3)]


def test_untrusted_target_has_no_pool(spark):
    from screenwell.operators import boosting, models
    rows = spark.createDataFrame([(k, [1.0]) for k in range(20)], "vec_id long, features array<double>")
    report = spark.createDataFrame([(0, "ready", 0.1), (1, "failed", None)], "target long, status string, r2 double")
    none = spark.createDataFrame([], f"target long, {boosting.TREE}")
    assert models.prescreen_pool(rows, none, report, "target", "vec_id").count() == 0


def test_qgram_md5_fp_equals_the_expression(spark, monkeypatch):
    from screenwell.functions import fingerprints as P
    texts = [None, "", "abc", "abcd", "a😀bcd äöü a😀bcd", "0123456789" * 30]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, text string")
    monkeypatch.setattr(P, "_KNOWN_GRAMS", 2)
    rows = df.select(P.qgram_fp("text", 4, 2048, "md5").alias("a"), P.qgram_md5_fp("text", 4, 2048).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows)


def test_alignments_are_numbered_by_split(spark, tmp_path):
    """No task takes a whole alignment: rows are dealt by split, and positions run on over splits and files."""
    from screenwell.sources.files import read_a3m
    for k, (a, b) in enumerate([(0, 40), (40, 41), (41, 90)]):
        (tmp_path / f"uniprot_id=P1").mkdir(exist_ok=True)
        (tmp_path / f"uniprot_id=P1/part-{k}.a3m").write_text("".join(f">s{i}\nACDE{'F' * (i % 7)}\n" for i in range(a, b)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        out = read_a3m(spark, str(tmp_path))
        rows = {r["pos"]: (r["header"], r["sequence"]) for r in out.collect()}
        plan = out.select("pos", "sequence")._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert rows == {i: (f"s{i}", "ACDE" + "F" * (i % 7)) for i in range(90)}
    numbering = [line for line in plan.splitlines() if "row_number()" in line and "windowspec" in line.lower()]
    assert numbering and all("__at" in line.split("windowspecdefinition(")[1].split(" ASC")[0] for line in numbering)
