"""The testcase-preserving merge, on cases worked out by hand from the rules."""

import base64
import hashlib

import pytest

from tracemill.plans.compat import CompatError, CompatMerge, Options

INCONSISTENT = frozenset(["inconsistent"])


def tracefile(*sections):
    """Sections of (testcase, source, rows in one string)."""
    return "".join(f"TN:{name}\nSF:{path}\n" + "".join(row + "\n" for row in rows.split()) + "end_of_record\n" for name, path, rows in sections)


def run(spark, folder, texts, check=True, **options):
    names = []
    for k, text in enumerate(texts):
        path = folder / f"{k}.info"
        path.write_text(text)
        names.append(str(path))
    plan = CompatMerge(spark, names, Options(**options))
    if check:
        plan.check()
    rows = [] if plan.lines.isEmpty() else [r.line for r in plan.ordered().collect()]
    return " ".join(rows).split(), plan


def test_branches_of_three_inputs(spark, tmp_path):
    # blocks are told apart by their kinds in order: "be" and "bb"; ids differ between inputs
    a = tracefile(("one", "/lib/k.c", "DA:4,9 BRDA:4,5,yes,2 BRDA:4,5,no,- BRDA:4,6,yes,0 BRDA:4,e6,throw,3"))
    b = tracefile(("one", "/lib/k.c", "DA:4,1 BRDA:4,1,oui,1 BRDA:4,e1,lance,0 BRDA:4,2,oui,4 BRDA:4,U2,non,1"))
    c = tracefile(("two", "/lib/k.c", "DA:4,5 BRDA:4,33,yes,1 BRDA:4,33,no,1"))
    got, _ = run(spark, tmp_path, [a, b, c], functions=False, branches=True)
    assert got == ["TN:one", "SF:/lib/k.c", "BRDA:4,0,yes,6", "BRDA:4,U0,no,1", "BRDA:4,1,yes,1", "BRDA:4,e1,throw,3", "BRF:3", "BRH:3", "DA:4,10", "LF:1", "LH:1", "end_of_record",
                   "TN:two", "SF:/lib/k.c", "BRDA:4,0,yes,1", "BRDA:4,0,no,1", "BRF:2", "BRH:2", "DA:4,5", "LF:1", "LH:1", "end_of_record"]


def test_branches_without_a_line(spark, tmp_path):
    # line 7 is made up from two hit branches of one testcase; line 8 is shared by two and stays out of the output
    text = tracefile(("p", "/lib/k.c", "DA:1,1 BRDA:7,0,a,2 BRDA:7,0,b,5 BRDA:8,0,a,1"), ("q", "/lib/k.c", "DA:2,1 BRDA:8,0,a,1"))
    with pytest.raises(CompatError, match="inconsistent"):
        run(spark, tmp_path, [text], functions=False, branches=True)
    got, plan = run(spark, tmp_path, [text], functions=False, branches=True, ignore=INCONSISTENT)
    assert [x for x in got if x.startswith("DA:")] == ["DA:1,1", "DA:7,2", "DA:2,1"]
    assert [(int(r.line), int(r["count"])) for r in plan.unserialized_lines.collect()] == [(8, 1)]


def test_hits_and_lines_of_functions(spark, tmp_path):
    # low has no hits but a hit line in its range; high is hit and has none
    text = tracefile(("u", "/lib/k.c", "FN:10,14,low FNDA:0,low FNL:5,20,23 FNA:5,6,high DA:9,1 DA:12,8 DA:13,2 DA:21,0"))
    with pytest.raises(CompatError, match="inconsistent"):
        run(spark, tmp_path, [text])
    got, _ = run(spark, tmp_path, [text], ignore=INCONSISTENT)
    assert got[2:8] == ["FNL:0,10,14", "FNA:0,8,low", "FNL:1,20,23", "FNA:1,6,high", "FNF:2", "FNH:2"]


def test_the_first_declaration_stands(spark, tmp_path):
    text = tracefile(("u", "/lib/k.py", "FNDA:9,f FN:3,5,f FNDA:2,f FN:30,35,f FNDA:4,f DA:3,1 DA:30,1 FNDA:7,g"))
    got, plan = run(spark, tmp_path, [text], keep_going=True)
    assert got[2:6] == ["FNL:0,3,5", "FNA:0,6,f", "FNF:1", "FNH:1"]
    said = {kind: message for kind, message, _ in plan.problem_kinds()}
    assert "inconsistent" in said and said["mismatch"] == "hits of a function that isn't declared"


def test_ends_reach_the_next_start(spark, tmp_path):
    text = tracefile(("u", "/lib/k.c", "FN:2,f FN:6,g FNDA:1,f FNDA:1,g DA:2,1 DA:4,3 DA:6,1"), ("v", "/lib/k.c", "DA:5,1 DA:9,1"), ("u", "/lib/k.py", "FN:2,f FNDA:1,f DA:2,1 DA:4,3"))
    got, _ = run(spark, tmp_path, [text], ignore=INCONSISTENT)
    assert [x for x in got if x.startswith("FNL:")] == ["FNL:0,2,5", "FNL:1,6,9", "FNL:0,2"]


def test_conditions(spark, tmp_path):
    # a missing sense is added, indexes are numbered anew, a line appears with the number of hit reachable senses
    text = tracefile(("m", "/lib/k.c", "DA:1,1 MCDC:6,2,f,3,4,p&&q MCDC:6,2,t,0,4,p&&q MCDC:6,2,t,2,9,r"))
    got, _ = run(spark, tmp_path, [text], functions=False, mcdc=True)
    assert got[2:] == ["MCDC:6,2,t,0,0,p&&q", "MCDC:6,2,f,3,0,p&&q", "MCDC:6,2,t,2,1,r", "MCDC:6,2,f,0,1,r", "MCF:4", "MCH:2", "DA:1,1", "DA:6,2", "LF:2", "LH:2", "end_of_record"]
    other = tracefile(("m", "/lib/k.c", "DA:1,1 MCDC:6,2,f,1,4,other"))
    with pytest.raises(CompatError, match="mismatch"):
        run(spark, tmp_path, [text, other], functions=False, mcdc=True)
    got, _ = run(spark, tmp_path, [text, other], functions=False, mcdc=True, ignore=frozenset(["mismatch"]))
    assert "MCDC:6,2,f,3,0,p&&q" in got


def test_testcases_need_lines(spark, tmp_path):
    text = tracefile(("seen", "/lib/k.c", "DA:3,1 FN:3,4,f FNDA:1,f"), ("unseen", "/lib/k.c", "FN:3,4,f FNDA:5,f BRDA:3,0,a,1"), ("seen", "/lib/none.c", "FN:1,2,z"))
    got, plan = run(spark, tmp_path, [text], check=False, branches=True, keep_going=True)
    assert [x for x in got if x[:3] in ("TN:", "SF:", "FNA", "BRD")] == ["TN:seen", "SF:/lib/k.c", "FNA:0,1,f"]


def test_recovery(spark, tmp_path):
    text = "TN:v 1,zz\nSF:/lib/k.c\nDA:1,2.75\nDA:2,-8\nDA:1,+1\nWHAT:x\nTN:late\nDA:3\nend_of_record\nKF:/lib/k.c\nDA:5,1e2\n"
    with pytest.raises(CompatError):
        run(spark, tmp_path, [text], functions=False)
    allowed = frozenset(["format", "negative"])
    assert run(spark, tmp_path, [text], functions=False, ignore=allowed)[0] == ["TN:v_1", "SF:/lib/k.c", "DA:1,3", "DA:2,0", "DA:5,100", "LF:3", "LH:2", "end_of_record"]
    with pytest.raises(CompatError, match="empty"):
        run(spark, tmp_path, [text, ""], functions=False, ignore=allowed)
    assert run(spark, tmp_path, ["", "# nothing\n"], functions=False, keep_going=True)[0] == []
    assert run(spark, tmp_path, [text], functions=False, ignore=allowed, forget_names=True)[0][0] == "TN:"


def test_versions_and_checksums(spark, tmp_path):
    digest = lambda line: base64.b64encode(hashlib.md5(line).digest()).decode().rstrip("=")
    source = tmp_path / "k.c"
    source.write_bytes(b"long k;\r\nlong m;\n")
    text = tracefile(("u", str(source), f"VER:77 DA:1,2 DA:2,3,{digest(b'long m;')}"))
    options = {"functions": False, "checksum": True, "ignore": frozenset(["version"])}
    assert run(spark, tmp_path, [text, text], **options)[0][2:5] == ["VER:77", f"DA:1,4,{digest(b'long k;')}", f"DA:2,6,{digest(b'long m;')}"]
    with pytest.raises(CompatError, match="version"):
        run(spark, tmp_path, [text, text.replace("VER:77", "VER:78")], functions=False)
    with pytest.raises(CompatError, match="source"):
        run(spark, tmp_path, [text.replace("k.c", "gone.c")], **options)
    source.write_bytes(b"long k;\nlong m;\n" + b"x" * (2 << 20) + b"\n")
    with pytest.raises(CompatError, match="source"):
        run(spark, tmp_path, [text], **options)
