"""The literal-key merge: random tracefiles against a merge written down as dictionaries, and the edges of the grammar."""

import random
from collections import Counter, defaultdict

import pytest

from tracemill.functions.paths import PathRules, glob_matches
from tracemill.plans import native
from tracemill.plans.native import Options, TraceError
from tracemill.sources.inputs import InputError, expand_lists, stage_stdin

LIMIT = 2**64 - 1
TAGS = ("FNF", "FNH", "BRF", "BRH", "MCF", "MCH", "LF", "LH")


class Source:
    """All that is known about one source after any number of sections."""

    def __init__(self):
        self.names, self.starts, self.aliases, self.declared, self.called = set(), set(), Counter(), set(), Counter()
        self.lines, self.sums, self.branches, self.conditions, self.expressions, self.rest = Counter(), defaultdict(set), {}, Counter(), defaultdict(set), Counter()

    def text(self, path):
        cap = lambda n: str(min(n, LIMIT))
        name = min(self.names) if len(self.names) == 1 else ""
        out = [f"TN:{name}"] * bool(name) + [f"SF:{path}"]
        for start, end, index in sorted(self.starts):
            out.append(f"FNL:{index},{start}" + f",{end}" * bool(end))
            out += [f"FNA:{index},{cap(n)},{alias}" for (group, alias), n in sorted(self.aliases.items()) if group == (start, end, index)]
        out += [f"FN:{start}," + f"{end}," * bool(end) + alias for start, end, alias in sorted(self.declared)]
        out += [f"FNDA:{cap(n)},{alias}" for alias, n in sorted(self.called.items())]
        out += [f"DA:{line},{cap(n)}" + "".join(f",{x}" for x in sorted(self.sums[line])[:1]) for line, n in sorted(self.lines.items())]
        rows = [(line, block, not isinstance(which, int), which if isinstance(which, int) else 0, "" if isinstance(which, int) else which, bits, marks, n) for (line, block, which, bits, marks), n in self.branches.items()]
        branches = [(marks, n) for *_, marks, n in sorted(rows)]
        out += [f"BRDA:{line},{marks}{block},{number if not named else which},{'-' if n is None else cap(n)}" for line, block, named, number, which, _, marks, n in sorted(rows)]
        conditions = sorted(self.conditions.items())
        out += [f"MCDC:{line},{'U' * away}{group},{'t' if sense else 'f'},{cap(n)},{index},{min(self.expressions[line, group, index, away, sense])}" for (line, group, index, away, sense), n in conditions]
        out += list(self.rest.elements()) if len(self.rest) < 2 else sorted(self.rest.elements())
        reachable = [n for marks, n in branches if "U" not in marks]
        reached = [n for (*_, away, _), n in conditions if not away]
        hit_groups = {group for (group, _), n in self.aliases.items() if n}
        counts = (len(self.starts) + len(self.declared), len(hit_groups) + sum(n > 0 for n in self.called.values()), len(reachable), sum(bool(n) for n in reachable),
                  len(reached), sum(n > 0 for n in reached), len(self.lines), sum(n > 0 for n in self.lines.values()))
        return "\n".join([*out, *(f"{t}:{n}" for t, n in zip(TAGS, counts, strict=True)), "end_of_record", ""])


def draw_section(rng, path, sources):
    """The rows of a random section, entered into ``sources`` as they are drawn."""
    s, rows = sources[path], []
    count = lambda: rng.choice([0, 0, 1, 2, 7, rng.randrange(10**6), LIMIT - 3])
    digits = lambda n: "0" * rng.choice([0, 0, 0, 3]) + str(n)
    for _ in range(rng.randrange(12)):
        line, n, kind = rng.randrange(1, 9), count(), rng.randrange(7)
        if kind == 0:
            own = rng.choice(["", "", "q1", "Zz", "é"])
            rows.append(f"DA:{digits(line)},{digits(n)}" + f",{own}" * bool(own))
            s.lines[line] += n
            s.sums[line] |= {own} - {""}
        elif kind == 1:
            end, index = rng.choice([0, line + 2]), rng.randrange(3)
            rows.append(f"FNL:{index},{line}" + f",{end}" * bool(end))
            s.starts.add((line, end, index))
            for alias in rng.sample(["go", "go2", "gö", "a,b"], rng.randrange(3)):
                hits = count()
                rows.append(f"FNA:{digits(index)},{hits},{alias}")
                s.aliases[(line, end, index), alias] += hits
        elif kind == 2:
            end, alias = rng.choice([0, line + 1]), rng.choice(["main", "ma", "x::y"])
            rows.append(f"FN:{line}," + f"{end}," * bool(end) + alias)
            s.declared.add((line, end, alias))
        elif kind == 3:
            alias = rng.choice(["main", "ma", "none", "p,q"])
            rows.append(f"FNDA:{n},{alias}")
            s.called[alias] += n
        elif kind == 4:
            marks, block, which = rng.choice(["", "", "e", "f", "U", "eU"]), rng.randrange(3), rng.choice([0, 2, 10, "left", "f(a,b)"])
            bits = 8 * ("e" in marks) + 16 * ("f" in marks) + 32 * ("U" in marks)
            hits = rng.choice([None, n])
            rows.append(f"BRDA:{line},{marks}{block},{digits(which) if isinstance(which, int) else which},{'-' if hits is None else hits}")
            key = (line, block, which, bits, marks)
            s.branches[key] = hits if s.branches.get(key) is None else s.branches[key] + (hits or 0)
        elif kind == 5:
            key = (line, rng.randrange(1, 3), rng.randrange(2), rng.random() < 0.3, rng.random() < 0.5)
            expression = rng.choice(["a & b", "a", "f(x, y)"])
            rows.append(f"MCDC:{key[0]},{'U' * key[3]}{key[1]},{'t' if key[4] else 'f'},{n},{key[2]},{expression}")
            s.conditions[key] += n
            s.expressions[key].add(expression)
        else:
            row = rng.choice(["VER:8", "NOTE:x,y", "Q:"])
            rows.append(row)
            s.rest[row] += 1
        if rng.random() < 0.2:
            rows.append(rng.choice(["", "# note", "LF:12", "FNH:007"]))
    return rows


def draw_file(rng, paths, sources):
    lines = []
    for path in rng.sample(paths, rng.randrange(len(paths) + 1)):
        name = rng.choice(["", "unit", "smoke", None])
        sources[path].names.add(name or "")
        lines += [f"TN:{name}"] * (name is not None) + [rng.choice(["SF:", "KF:"]) + path, *draw_section(rng, path, sources), "end_of_record"]
    end = rng.choice(["\n", "\r\n"])
    text = end.join(lines) + end * bool(lines)
    return text.removesuffix("end_of_record" + end) if rng.random() < 0.2 else text


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("traces")
    count = iter(range(10**6))

    def write(texts):
        names = []
        for text in texts:
            path = folder / f"{next(count)}.info"
            path.write_bytes(text if isinstance(text, bytes) else text.encode())
            names.append(str(path))
        return names

    return write


def merged(spark, names, options=Options(), **reader):
    plan = native.plan_merge(spark, names, options, **reader)
    plan.check()
    return "".join(r.line + "\n" for r in plan.lines().collect())


def test_random_tracefiles(spark, files):
    rng = random.Random(20)
    sources = defaultdict(Source)
    texts = [draw_file(rng, ["/w/a.c", "/w/a", "/w/é.c", "z\\b.c", "/w/b c.h"], sources) for _ in range(60)]
    expected = "".join(sources[path].text(path) for path in sorted(sources, key=str.encode))
    names = files(texts)
    assert merged(spark, names) == expected
    assert merged(spark, names[::-1], range_bytes=61) == expected
    # a merge of merges, and of the merge alone
    halves = [merged(spark, names[k::2]) for k in (0, 1)]
    if not any(len(s.names) > 1 for s in sources.values()):
        assert merged(spark, files(halves)) == expected
    assert merged(spark, files([expected])) == expected


EDGES = {
    "": "", "\n# only a note\n": "", "TN:x\n": "", "SF:/q": "SF:/q", "TN:x\nKF:/q\n": "TN:x|SF:/q", "SF:/q\r\nDA:6,0\r": "SF:/q|DA:6,0",
    "SF:/q\nDA:2,5\nend_of_recordKF:/r\nDA:2,6\n": "SF:/q|DA:2,5||SF:/r|DA:2,6", "SF:/q\nend_of_record\nSF:/q\nFNDA:3,f\nend_of_record\n": "SF:/q|FNDA:3,f",
}


@pytest.mark.parametrize("text", EDGES)
def test_edges_of_the_grammar(spark, text):
    from tracemill.sources.lcov import records_from_table

    plan = native.Merge(records_from_table(spark.createDataFrame([(0, text)], "input_id bigint, body string")))
    plan.check()
    body = [r.line for r in plan.lines().collect()]
    kept = "|".join("" if x.startswith("FNF:") else x for x in body)
    assert kept.strip("|") == EDGES[text]


def plain(path, *rows):
    return "\n".join([f"SF:{path}", *rows, "end_of_record", ""])


def test_options(spark, files):
    names = files([plain(f"/home/ci/job/{x}.c", "DA:3,4") for x in ("lib/core", "lib/cord", "lib/cold", "test/core")])
    rules = PathRules((("/home/ci", "/srv/build"),), "/srv/build/job", ("lib/co[l-r][de].c",), ("*/cold.*",))
    assert [x for x in merged(spark, names, Options(rules)).split("\n") if x.startswith("SF:")] == ["SF:lib/cord.c", "SF:lib/core.c"]
    text = merged(spark, files([plain("/k.c", "BRDA:?", "FN:?", "FNL:?", "DA:8,3")]), Options(branches=False, functions=False))
    assert text.startswith("SF:/k.c\nDA:8,3\nFNF:0\n")
    pair = files([plain("/k.c", "DA:8,3,one"), plain("/k.c", "DA:8,3,two")])
    assert "DA:8,6,one\n" in merged(spark, pair)
    with pytest.raises(TraceError, match="checksum"):
        merged(spark, pair, Options(strict_checksum=True))


def test_families_of_records(spark, files):
    text = plain("/k.c", "FN:1,f", "FNDA:2,f", "FNL:0,3", "FNA:0,1,g", "BRDA:1,0,0,1", "MCDC:1,1,t,1,0,e", "DA:1,1")
    for options, left in ((Options(), "FN FNA FNDA FNL BRDA MCDC DA"), (Options(functions=False), "BRDA MCDC DA"), (Options(branches=False), "FN FNA FNDA FNL MCDC DA"), (Options(functions=False, branches=False), "MCDC DA")):
        got = {x.partition(":")[0] for x in merged(spark, files([text]), options).split("\n")} - {"SF", "end_of_record", "", *TAGS}
        assert got == set(left.split())


REWRITES = [
    (PathRules((("/mnt/ci", "E:\\tree"),)), "/mnt/ci/lib/x.h", "E:\\tree\\lib\\x.h"), (PathRules((("E:\\tree", "/mnt"),)), "E:\\tree\\lib/x.h", "/mnt/lib/x.h"),
    (PathRules((("E:\\tree", "out"),)), "E:\\tree\\lib\\x.h", "out\\lib\\x.h"), (PathRules((("/mnt/ci", "/k"),)), "/mnt/cider/x.h", "/mnt/cider/x.h"), (PathRules((("/mnt/ci/", "/k/"),)), "/mnt/ci/x.h", "/k/x.h"),
    (PathRules((("", "/root"),)), "x/y.h", "/root/x/y.h"), (PathRules((("/mnt/ci", ""),)), "/mnt/ci/x.h", "x.h"), (PathRules(strip="/mnt/ci"), "/mnt/ci///x.h", "x.h"), (PathRules(strip="/mnt/ci"), "/mnt/circle.h", "/mnt/circle.h"),
    (PathRules((("/1", "/2"), ("/2", "/3"), ("/1", "/4")), "/3"), "/1/x", "x"),
]
GLOBS = [
    ("lib/*.h", "lib/x/y.h", True), ("lib/?.h", "lib/xy.h", False), ("ß", "ß", True), ("?", "ß", False), ("??", "ß", True), ("[q", "[q", True), ("*tail", "*tail", True), ("*", "*tail", False), ("*", "", True),
    ("[]", "q", False), ("[^]", "q", True), ("p*q*r", "p1q22r", True), ("p*q*r", "p1r", False), ("[x-z]?", "y1", True), ("[!x-z]?", "y1", False), ("[z-x]", "y", False), ("q", "qq", False), ("**", "*q", True), ("[a-c]*", "[a-c]", True)]


def test_rewriting_in_both_forms(spark):
    from pyspark.sql import functions as F

    from tracemill.functions import paths

    df, columns = spark.range(1), []
    for k, (rules, path, expected) in enumerate(REWRITES):
        assert rules.rewrite(path) == expected
        column = F.lit(path)
        for old, new in rules.rebases:
            column = paths.rebased(column, old, new)
        columns.append((column if rules.strip is None else paths.stripped(column, rules.strip)).alias(f"c{k}"))
    assert list(df.select(*columns).collect()[0]) == [e for _, _, e in REWRITES]


def test_normalized_paths(spark):
    import posixpath

    from pyspark.sql import functions as F

    from tracemill.functions.paths import normalized

    rng = random.Random(5)
    texts = ["", "/", "//", "///", ".", "..", "/..", "a\\..\\b"] + ["".join(rng.choice(["/", "..", ".", "a", "b", "\\"]) for _ in range(rng.randrange(9))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "k int, p string").select("k", normalized(F.col("p")).alias("n")).collect()
    assert {r.k: r.n for r in got} == {k: posixpath.normpath(t.replace("\\", "/")) for k, t in enumerate(texts)}


def test_generated_shards(spark, tmp_path):
    from tracemill.sources.generate import write_shards

    write_shards(spark, str(tmp_path / "made"), 3, 4, 5, functions=2, branches=1)
    names = sorted(str(p) for p in (tmp_path / "made").glob("part-*"))
    text = merged(spark, names)
    assert len(names) == 3 and text.count("DA:") == 4 * (5 + 2 + 1) and text.count("\nFN:") == 8 and merged(spark, names) == text


def simple_glob(pattern, text):
    """Matching by trying everything, for ASCII texts without glob characters."""
    if not pattern or not text:
        return not pattern.strip("*") and not text
    if pattern[0] == "*":
        return simple_glob(pattern[1:], text) or simple_glob(pattern, text[1:])
    return pattern[0] in ("?", text[0]) and simple_glob(pattern[1:], text[1:])


def test_globs(spark):
    from pyspark.sql import functions as F

    from tracemill.functions.paths import apply_rules, selected

    assert [glob_matches(p, t) for p, t, _ in GLOBS] == [e for _, _, e in GLOBS]
    rng = random.Random(3)
    drawn = [("".join(rng.choice("ab*?") for _ in range(rng.randrange(6))), "".join(rng.choice("ab/") for _ in range(rng.randrange(7)))) for _ in range(300)]
    assert [glob_matches(p, t) for p, t in drawn] == [simple_glob(p, t) for p, t in drawn]
    usual = [(p, t, e) for p, t, e in GLOBS if "*" not in t and "[" not in t]
    row = spark.range(1).select(*[selected(F.lit(t), (p,)).alias(f"c{k}") for k, (p, t, _) in enumerate(usual)]).collect()[0]
    assert list(row) == [e for _, _, e in usual]
    kept = apply_rules(spark.createDataFrame([("*tail", 1), ("*", 2), ("q", 3), (None, 4)], "p string, keep int"), "p", PathRules(includes=("*",))).collect()
    assert sorted(r.p for r in kept) == ["*", "q"]


@pytest.mark.parametrize(("content", "line", "message"), [
    ("SF:/k\nDA:3,x", 2, "bad DA"), ("DA:3,4\n", 1, "before a source"), (b"SF:/k\nX:\x00", 2, "UTF-8"), (b"SF:/k\n\nX:\xfe", 3, "UTF-8"), ("SF:/k\nX:" + "y" * (1 << 20), 2, "1 MiB"), ("SF:/k\nDA:3,", 2, "bad DA"),
    ("end_of_record\n", 1, "no open source"), ("SF:/k\nFNA:4,2,f\n", 2, "FNL"), ("SF:/k\nFNL:4,2\nFNA:5,2,f\n", 3, "FNL"), ("SF:/k\nFNL:4,2\nFNA:4,2,\n", 3, "name"), ("SF:/k\nMCDC:3,2,T,1,0,e\n", 2, "bad MCDC"), ("SF:/k\nBRDA:3,4,5\n", 2, "bad BRDA"),
    ("SF:/k\nBRH:-1\n", 2, "bad BRH"), ("SF:/k\nKF:/m\n", 2, "still open"), ("TN:p\nTN:q\n", 2, "second TN"), ("SF:\n", 1, "without a path"), (f"SF:/k\nDA:3,{LIMIT + 1}\n", 2, "bad DA"), ("SF:/k\nno colon\n", 2, "no record"), ("SF:/k\nTN:p\n", 2, "no record")])
def test_malformed(content, line, message):
    from tracemill.sources.lcov import lines_of, tokenize

    data = content if isinstance(content, bytes) else content.encode()
    *_, last = tokenize(lines_of(data), 0, PathRules())
    assert message in last[-2] and data[: last[1]].count(b"\n") + 1 == line


def test_lines_of_ranges():
    import io

    from tracemill.sources.inputs import numbered_lines

    rng = random.Random(1)
    for _ in range(300):
        data = b"\n".join(b"x" * rng.choice([0, 1, 3, 9, 40]) for _ in range(rng.randrange(1, 9)))
        cuts = sorted(rng.randrange(len(data) + 1) for _ in range(3))
        got = [x for a, b in zip([0, *cuts], [*cuts, len(data)]) for x in numbered_lines(io.BytesIO(data), a, b, 5, piece=rng.choice([1, 3, 100]))]
        at, expected = 0, []
        for line in data.split(b"\n"):
            expected.append((at, line[:6]))
            at += len(line) + 1
        assert got == (expected[:-1] if not expected[-1][1] else expected)


def test_ranges_within_one_section(spark, files):
    rows = [f"FNL:{k},{k + 1}\nFNA:{k},1,f{k}\nDA:{k},1" for k in range(300)]
    text = "TN:t\n" + plain("/one.c", *rows) + "TN:u\nSF:/two.c\nDA:1,1\nend_of_recordSF:/three.c\nDA:2,1\n" + "\n".join(f"BRDA:{k},0,0,-" for k in range(100)) + "\nend_of_record\n"
    small = [plain(f"/s{k % 5}.c", f"DA:{k % 3},1") for k in range(40)]
    names = files([text, *small])
    whole = merged(spark, names)
    assert whole.count("DA:") == 300 + 2 + 100 + 15
    for size in (40, 333, 4000):
        assert merged(spark, names, range_bytes=size) == whole


def test_sources_left_out_are_checked(spark, files):
    with pytest.raises(TraceError):
        merged(spark, files([plain("/left/out.c", "BRDA:3")]), Options(PathRules(includes=("*.h",))))


def test_run_writes_atomically(spark, files, tmp_path, capsys):
    out = tmp_path / "out.info"
    out.write_text("earlier")
    good, bad = files([plain("/k.c", "DA:5,2", "Q:r")]), files([plain("/k.c", "", "DA:5")])
    with pytest.raises(TraceError, match=":3: bad DA"):
        native.run(spark, bad, str(out))
    assert out.read_text() == "earlier" and [p.name for p in tmp_path.iterdir()] == ["out.info"]
    assert native.run(spark, good * 3, str(out), Options(warn_unknown=True), stats=True) == 0
    assert out.read_text().startswith("SF:/k.c\nDA:5,6\nQ:r\nQ:r\nQ:r\nFNF:0\n")
    said = capsys.readouterr().err
    assert "unknown record Q" in said and "stats LF=1 LH=1" in said
    with pytest.raises(InputError):
        native.run(spark, [str(tmp_path / "none")], str(out))


def test_inputs(tmp_path):
    import io

    (tmp_path / "list").write_text(f"# note\n\nx.info\n@{tmp_path}/other\n@@y\n")
    (tmp_path / "other").write_text("z.info\n")
    assert expand_lists([f"@{tmp_path}/list", "w"]) == ["x.info", "z.info", "@y", "w"]
    (tmp_path / "loop").write_text(f"@{tmp_path}/loop\n")
    with pytest.raises(InputError):
        expand_lists([f"@{tmp_path}/loop"])
    with pytest.raises(InputError):
        stage_stdin(["-", "-"])
    staged = stage_stdin(["w", "-"], io.BytesIO(b"SF:/k\n"))
    assert open(staged[1]).read() == "SF:/k\n"
