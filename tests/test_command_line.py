"""Command line, settings, and shards that arrive in parts."""

import pytest

from tracemill.__main__ import compat_options, compat_parser, main
from tracemill.plans import native
from tracemill.sources.config import interpolated, read_settings, size
from tracemill.sources.inputs import InputError, expand_globs
from tracemill.streaming.incremental import IncrementalMerge


def test_settings(tmp_path, monkeypatch):
    monkeypatch.setenv("PLACE", "x")
    (tmp_path / "a").write_text("# c\nbranch_coverage = 1\nconfig_file = b\ninclude = $ENV{PLACE}/*\nother = 1\n")
    (tmp_path / "b").write_text("checksum=yes\nignore_errors = format\n")
    assert read_settings(str(tmp_path / "a")) == [("branch_coverage", "1"), ("checksum", "yes"), ("ignore_errors", "format"), ("include", "x/*"), ("other", "1")]
    o = compat_options(compat_parser().parse_args(["--config-file", str(tmp_path / "a"), "--rc", "mcdc_coverage=1", "--no-checksum", "--exclude", "y"]))
    assert (o.branches, o.checksum, o.mcdc, o.ignore, o.rules.includes, o.rules.excludes) == (True, False, True, frozenset(["format"]), ("x/*",), ("y",))
    (tmp_path / "b").write_text("config_file = a\n")
    with pytest.raises(InputError):
        read_settings(str(tmp_path / "a"))
    with pytest.raises(InputError):
        compat_options(compat_parser().parse_args(["--ignore-errors", "path"]))
    for flags, mcdc in ((["--no-mcdc-coverage", "--mcdc-coverage"], True), (["--mcdc-coverage", "--no-mcdc-coverage"], False), ([], False)):
        assert compat_options(compat_parser().parse_args(flags)).mcdc is mcdc
    assert not compat_options(compat_parser().parse_args(["--no-branch-coverage", "--branch-coverage"])).branches
    with pytest.raises(InputError, match="omit_lines"):
        compat_options(compat_parser().parse_args(["--rc", "omit_lines=x"]))
    assert size("8M") == 8 << 20 and interpolated("a$ENV{PLACE}") == "ax"


def test_globs(tmp_path):
    for name in ("b.info", "a.info"):
        (tmp_path / name).write_text("")
    pattern = str(tmp_path / "*.info")
    assert [p[-6:] for p in expand_globs([pattern, pattern])] == ["a.info", "b.info"] * 2
    assert [p[-6:] for p in expand_globs([pattern, pattern], dedupe=True, without=[str(tmp_path / "a.info")])] == ["b.info"]
    with pytest.raises(InputError):
        expand_globs([str(tmp_path / "*.none")])


def test_statuses(spark, tmp_path, capsys):
    (tmp_path / "a.info").write_text("SF:/a.c\nDA:1,1\nend_of_record\n")
    (tmp_path / "bad.info").write_text("SF:/a.c\nDA:x\n")
    out = str(tmp_path / "out.info")
    assert main([str(tmp_path / "a.info"), "-o", out, "-j", "2", "--mem-limit", "8M"], spark) == 0
    assert open(out).read().startswith("SF:/a.c\nDA:1,1\nFNF:0")
    assert main([str(tmp_path / "bad.info"), "-o", out], spark) == 2
    assert main([str(tmp_path / "none.info"), "-o", out], spark) == 3
    assert main(["-o", out], spark) == 1


def test_arriving_shards(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    texts = ["TN:a\nSF:/s.c\nDA:1,1,z\nBRDA:1,0,0,-\nX:y\nFN:1,f\nFNDA:1,f\nend_of_record\n", "TN:b\nSF:/s.c\nDA:1,2,a\nBRDA:1,0,0,-\nX:y\nMCDC:1,1,t,1,0,e\nend_of_record\n", "TN:b\nSF:/s.c\nDA:1,2\nBRDA:1,0,0,2\nFNL:0,1\nFNA:0,3,g\nend_of_record\n"]
    stream = IncrementalMerge(spark, str(tmp_path / "out"))
    for k, text in enumerate(texts):
        (folder / f"{k}.info").write_text(text)
        stream.run(str(folder))
    once = native.plan_merge(spark, [str(folder / f"{k}.info") for k in range(3)])
    lines = lambda m: [r.line for r in native.ordered_lines(m, native.source_summaries(m)).collect()]
    assert lines(stream.merged()) == lines(once.merged)


def test_conflicts_within_a_batch_stay(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    stream = IncrementalMerge(spark, str(tmp_path / "out"))
    rows = "DA:1,3,{0}\nMCDC:1,1,t,1,0,{0}\n{1}end_of_record\n"
    (folder / "0.info").write_text("".join("TN:" + t + "\nSF:/a.c\n" + rows.format(t, "X:same\n" * 3) for t in "pqr"))
    stream.run(str(folder))
    (folder / "1.info").write_text("TN:p\nSF:/a.c\n" + rows.format("p", ""))
    stream.run(str(folder))
    once = native.plan_merge(spark, [str(folder / f"{k}.info") for k in range(2)])
    whole = lambda m: sorted(map(str, m.collect()))
    assert whole(stream.merged()) == whole(once.merged)
    got = {r.kind: (r.chosen, r.most, r.conflict, r.copies) for r in stream.merged().collect()}
    assert got[8] == got[7] == ("p", "r", True, 4) and got[1][2] and got[9][3] == 9
    assert sum(r.line == "X:same" for r in native.ordered_lines(once.merged, once.summaries).collect()) == 9


def test_malformed_shard_is_not_taken_in(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    stream = IncrementalMerge(spark, str(tmp_path / "out"))
    good, mended = "SF:/a.c\nDA:1,1\nend_of_record\n", "SF:/b.c\nDA:1,2\nDA:2,3\nend_of_record\n"
    (folder / "0.info").write_text(good)
    stream.run(str(folder))
    (folder / "1.info").write_text(mended.replace("DA:2,3", "DA:2,x"))
    for _ in range(2):
        with pytest.raises(Exception, match="1.info:3: bad DA"):
            stream.run(str(folder))
        assert {r.path for r in stream.merged().collect()} == {"/a.c"}
    (folder / "1.info").write_text(mended)
    stream.run(str(folder))
    once = native.plan_merge(spark, [str(folder / f"{k}.info") for k in range(2)])
    lines = lambda m: [r.line for r in native.ordered_lines(m, native.source_summaries(m)).collect()]
    assert lines(stream.merged()) == lines(once.merged)
