"""Files of any layout, and domains of any number."""

import random
from datetime import date

import pytest

from brisk.operators import daily
from brisk.sources import logs


def test_answer_files_of_any_width(spark, tmp_path):
    (tmp_path / "r4.2").mkdir()
    wide = [f"x{i}" for i in range(16)]
    (tmp_path / "r4.2/wide.csv").write_text(",".join([*wide, "user", "date", "type", "id"]) + "\n" + ",".join(["1"] * 16 + ["u1", "2010-01-02 03:04", "logon", "e1"]) + "\n" + ",".join(["1"] * 16 + ["", "2010-01-02 03:04", "logon", "e2"]) + "\n")
    (tmp_path / "r4.2/plain.csv").write_text('logon,007,01/02/2010 07:13:00,u2,more\nfile,"{a,b}",01/03/2010 07:13:00,u3\nfile\n')
    (tmp_path / "r4.2/first.csv").write_text("﻿ Time ,username,user,ID\n2010-02-01 00:00:00,a,b,1\n2010-02-02 00:00:00,,b,2\n")
    got = sorted((r["source_file"], r["user"], r["event_type"], r["event_id"], str(r["timestamp"])) for r in logs.answers(spark, str(tmp_path)).collect())
    assert got == [
        ("first.csv", "a", "unknown", "1", "2010-02-01 00:00:00"), ("plain.csv", "u2", "logon", "007", "2010-01-02 07:13:00"), ("plain.csv", "u3", "file", "{a,b}", "2010-01-03 07:13:00"),
        ("wide.csv", "u1", "logon", "e1", "2010-01-02 03:04:00"),
    ]
    assert sorted(map(tuple, logs.answer_counts(spark, str(tmp_path)).collect())) == [("first.csv", 2, 1), ("plain.csv", 3, 1), ("wide.csv", 2, 1)]


def test_snapshots_with_headers_of_their_own(spark, tmp_path):
    for i in range(1, 8):
        head = ["user_id", "email", "role", "department", "team", "more"]
        random.Random(i).shuffle(head)
        (tmp_path / f"2010-{i:02}.csv").write_text(("﻿" if i == 3 else "") + ",".join(head) + "\n" + "\n".join(",".join(f"{c}{i}{k}" for c in head) for k in range(3)) + "\n")
    (tmp_path / "2010-09.csv").write_text("user_id,email\na,b\n")
    (tmp_path / "notes.csv").write_text("user_id,email,role,department,team\na,b,c,d,e\n")
    (tmp_path / "2010-13.csv").write_text("user_id,email,role,department,team\na,b,c,d,e\n")
    got = sorted(map(tuple, logs.snapshots(spark, str(tmp_path)).collect()))
    assert got == sorted((f"user_id{i}{k}", date(2010, i, 1), f"role{i}{k}", f"department{i}{k}", f"team{i}{k}", f"email{i}{k}") for i in range(1, 8) for k in range(3))
    (tmp_path / "other").mkdir()
    (tmp_path / "other/2010-09.csv").write_text("user_id,email\na,b\n")
    with pytest.raises(ValueError):
        logs.snapshots(spark, str(tmp_path / "other"))
    assert logs.snapshots(spark, str(tmp_path / "none")).count() == 0


def test_a_table_of_domains_counts_like_a_list(spark):
    rng = random.Random(2)
    people = lambda: "; ".join(rng.choice(["a@in.com", "b@IN.com", "c@out.com", "noat", " ", "d@x@in.com", "e@d77.org"]) for _ in range(rng.randrange(5)))
    mails = spark.createDataFrame([(f"u{i % 7}", date(2024, 1, 1 + i % 5), people(), people()) for i in range(200)], "user string, day date, to string, cc string").repartition(3)
    mails = mails.selectExpr("*", "cast(day as timestamp_ntz) as timestamp")
    many = [f"d{i}.org" for i in range(100_000)] + ["in.com"]
    table = spark.createDataFrame([(d,) for d in many], "domain string")
    of = lambda domains: sorted(map(str, daily.email_days(mails, daily.Terms(7, 18, domains=domains)).collect()))
    assert of(table) == of(("in.com", "d77.org"))
    assert of(table.where("false")) == of(())
    plan = daily.email_days(mails, daily.Terms(7, 18, domains=table))._jdf.queryExecution().toString()
    assert "d99.org" not in plan
