"""Golden lines per parser, one case per trap."""

from datetime import datetime

from pyspark.sql import functions as F

from huntframe.operators.parse_generic import parse_generic, route_generic
from huntframe.operators.parse_syslog import parse_syslog
from huntframe.operators.parse_web import parse_access
from huntframe.operators.parse_windows import parse_windows, windows_errors
from huntframe.schema import LOG_ENTRY
from huntframe.sources.lines import parse_logs, read_json_array, read_lines, read_log, run_stats


def lines(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq long, value string")


def rows(df):
    return sorted(df.collect(), key=lambda r: r.seq)


def test_access_line_keeps_wall_clock_and_instant(spark):
    df = parse_access(lines(spark, '1.2.3.4 - frank [10/Oct/2024:13:55:36 -0700] "GET /a b HTTP/1.1" 404 2326 "-" "Mozilla"', "1.2.3.4 - - [bad] \"\" 200 -"))
    assert df.schema.simpleString() == LOG_ENTRY.simpleString()
    one, two = rows(df)
    assert (one.ts, one.ts_local) == (datetime(2024, 10, 10, 20, 55, 36), datetime(2024, 10, 10, 13, 55, 36))
    assert (one.http_method, one.http_path, one.extra["protocol"], one.username, one.log_level, one.bytes_sent) == ("GET", "/a", "b HTTP/1.1", "frank", "WARNING", 2326)
    assert (two.ts, two.username, two.http_method, two.http_path, two.bytes_sent, two.user_agent, two.parse_ok) == (None, None, None, "", None, None, True)


def test_error_lines_and_broken_lines(spark):
    a, b, c = rows(parse_access(lines(spark, "[Thu Oct 10 13:55:36 2024] [error] [pid 1] it broke", "[Thu Oct 10 13:55:36.123456 2024] [warn] slow", "[Thu Oct 10 13:55:36 2024] [core:error] x", "")))
    assert (a.ts, a.log_level, a.message, a.parse_ok) == (datetime(2024, 10, 10, 13, 55, 36), "ERROR", "it broke", True)
    assert (b.ts, b.log_level) == (None, "WARN")  # the year goes with the fraction
    assert (c.parse_ok, c.message) == (False, "[Thu Oct 10 13:55:36 2024] [core:error] x")


def test_syslog_forms(spark):
    found = rows(
        parse_syslog(
            lines(
                spark,
                "Jan  5 03:22:14 web sshd[12]: Failed password for invalid user bob from 10.0.0.5 port 1",
                "Xyz 31 03:22:14 web cron: hello",
                "Feb 30 03:22:14 web cron: from address",
                "<34>1 2024-05-01T10:00:00+02:00 web app - ID - ok",
                "# comment",
                "nonsense",
                "Jan  5 03:22:14 web sudo: alice : TTY=x ; COMMAND=/bin/ls",
            ),
            2023,
        )
    )
    a, b, c, d, e, f = found
    assert (a.ts, a.pid, a.username, a.source_ip, a.log_level, a.process) == (datetime(2023, 1, 5, 3, 22, 14), 12, "bob", "10.0.0.5", "ERROR", "sshd")
    assert b.ts == datetime(2023, 1, 31, 3, 22, 14)  # an unknown month is January
    assert (c.ts, c.source_ip) == (None, "add")  # no such day; hex letters count as an address
    assert (d.ts, d.ts_local, d.pid) == (datetime(2024, 5, 1, 8), datetime(2024, 5, 1, 10), None)
    assert (e.parse_ok, e.message) == (False, "nonsense")
    assert f.username is None  # the process name has been consumed by the line format


def test_windows_layouts(spark):
    data = lines(
        spark,
        '{"EventID": 4625, "TimeCreated": "2024-01-01T00:00:00.1234567Z", "EventData": {"SubjectUserName": "SYSTEM", "TargetUserName": "bob", "IpAddress": "-", "LogonType": "10"}}',
        '{"event_id": "1102", "timestamp": "1/2/2024 3:04:05 PM", "EventData": {}, "event_data": {"TargetUserName": " al "}}',
        "[1]",
        "no json",
        '{"System": {"EventID": "7", "Level": "1"}}',
    )
    a, b, c, d = rows(parse_windows(data))
    assert (a.ts, a.username, a.source_ip, a.message) == (None, None, None, "Failed Logon [RemoteInteractive (RDP)]")  # Z cut off; SYSTEM is nobody, and no one else
    assert (b.ts, b.username, b.message) == (datetime(2024, 1, 2, 15, 4, 5), "al", "Audit Log Cleared")
    assert (c.parse_ok, c.message) == (False, "no json")
    assert (d.log_level, d.message) == ("CRITICAL", "Event 7")
    assert windows_errors(data).first().errors == 2


def test_generic_routes(spark):
    data = lines(spark, '{"src": "-", "client_ip": "1.1.1.1", "A": {"User": "u"}, "status": "200.0"}', 'src= user="a b" user=c status=5', "client 9.9.9.9 ERROR at 2024-01-02 03:04:05 GET /x status: 404", "k=v only one pair", "{broken")
    assert [r.route for r in rows(route_generic(data))] == ["json", "kv", "text", "text", "text"]
    a, b, c, d, e = rows(parse_generic(data))
    assert (a.source_ip, a.username, a.http_status, a.log_level) == ("1.1.1.1", "u", None, "INFO")
    assert (b.username, b.http_status) == ("c", 5)  # the later pair wins
    assert (c.source_ip, c.ts, c.http_method, c.http_path, c.http_status, c.log_level) == ("9.9.9.9", datetime(2024, 1, 2, 3, 4, 5), "GET", "/x", 404, "ERROR")
    assert (d.message, e.message) == ("k=v only one pair", "{broken")


def test_files_and_counts(spark, tmp_path):
    (tmp_path / "a.log").write_text("x  \n\ny=1 z=2\n")
    read = read_lines(spark, str(tmp_path / "a.log"))
    assert [r.value for r in rows(read)] == ["x", "", "y=1 z=2"]
    stats = run_stats(read, parse_logs(read, "unheard of"), "generic").first()
    assert (stats.log_format, stats.total_lines, stats.parsed_lines, stats.parse_errors) == ("generic", 3, 2, 0)
    (tmp_path / "b.json").write_text('[{"EventID": "4624"},\n {"EventID": "1"}]')
    assert [r.event_id for r in rows(parse_windows(read_json_array(spark, str(tmp_path / "b.json"))))] == ["4624", "1"]


def test_empty_input(spark):
    for name in ("apache", "syslog", "windows_event", "generic"):
        assert parse_logs(spark.createDataFrame([], "seq long, value string"), name).count() == 0


def test_lines_are_numbered_by_file_and_place(spark, tmp_path):
    (tmp_path / "b 1%.log").write_text("b0\nb1\x0bb2\n\nb3\n")
    (tmp_path / "a.log").write_text("".join(f"a{i}\n" for i in range(50)))
    for split, bs in ((False, ["b0", "b1\x0bb2", "", "b3"]), (True, ["b0", "b1", "b2", "", "b3"])):
        read = read_lines(spark, str(tmp_path), split)
        got = rows(read)
        assert [r.value for r in got] == [f"a{i}" for i in range(50)] + bs
        assert len({r.seq for r in got}) == len(got)
        assert parse_logs(read, "generic").count() == len([b for b in bs if b]) + 50
    assert {r.ts.year for r in parse_logs(read.withColumn("value", F.lit("Mar  5 03:22:14 web cron: x")), "syslog").collect()} == {datetime.now().year}


def test_windows_files_are_arrays_or_lines(spark, tmp_path):
    (tmp_path / "array file.json").write_text('\n [{"EventID": "4624"},\n {"EventID": 1}, 5]')
    (tmp_path / "lines.json").write_text('[1]\n{"EventID": "2"}\nbroken')
    read = read_log(spark, str(tmp_path), "windows_event")
    entries = parse_logs(read, "windows_event")
    assert [r.event_id for r in rows(entries)] == ["4624", "1", "2", None]
    stats = run_stats(read, entries, "windows_event").first()
    assert (stats.total_lines, stats.parsed_lines, stats.parse_errors) == (6, 4, 3)  # 5, [1] and broken
    none = spark.createDataFrame([], "seq long, value string")
    assert tuple(run_stats(none, parse_logs(none, "syslog"), "syslog").first()) == ("syslog", 0, 0, 0)


def test_classes_are_those_of_unicode(spark):
    a = rows(parse_syslog(lines(spark, "Jän 10 03:22:14 web cron: x\u00a0"), 2024))[0]
    assert (a.ts, a.message, a.parse_ok) == (datetime(2024, 1, 10, 3, 22, 14), "x", True)  # no such month is January
    b = rows(parse_generic(lines(spark, "usér=x src=1.2.3.4 user=bob\u2028y")))[0]
    assert b.extra["usér"] == "x" and (b.source_ip, b.username) == ("1.2.3.4", "bob")
    c = rows(parse_access(lines(spark, '1.2.3.4\u00a0- - [10/Oct/2024:13:55:36 +0000] "GET /a\ufdd0b HTTP/1.1" 200 5 "-" "x\u2028y"')))[0]
    assert (c.http_path, c.user_agent, c.parse_ok) == ("/ab", "x\u2028y", True)  # U+FDD0 is no character


def test_a_filter_reads_no_line_anew(spark):
    """What a line is read into is worked out once, wherever a filter on it stands; the two readings of pairs are for ASCII text and for any."""
    found = parse_generic(lines(spark, "seen 1.2.3.4 k=1", "GET /a status=200", 'a=1 b="x=\\"', 'b="" é=2 a="c')).filter("http_method IS NULL")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(") == 2 and plan.count("from_json(") <= 2
    assert [(r.source_ip, r.extra) for r in rows(found)] == [("1.2.3.4", None), (None, {"a": "1", "b": "x=\\"}), (None, {"b": "", "é": "2", "a": '"c'})]
