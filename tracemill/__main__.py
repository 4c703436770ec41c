"""Command line of both merges; statuses 0 done, 1 usage or a problem, 2 malformed input, 3 input or output."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tracemill import __version__
from tracemill.functions.paths import PathRules
from tracemill.plans import compat, native
from tracemill.session import clear_scratch, scratch_path
from tracemill.sources.config import boolean, discover, read_settings, refuse_unsupported
from tracemill.sources.inputs import InputError, check_regular, expand_globs, stage_stdin

# fixed values: settings with a meaning here, and what they set
SETTINGS = {"function_coverage": "functions", "branch_coverage": "branches", "mcdc_coverage": "mcdc", "checksum": "checksum", "check_data_consistency": "consistency",
            "derive_function_end_line": "derive_ends", "forget_testcase_names": "forget_names", "ignore_errors": None, "include": None, "exclude": None}


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise InputError(message, 1)


def _pair(text: str) -> tuple[str, str]:
    old, equals, new = text.partition("=")
    if not equals:
        raise InputError(f"not OLD=NEW: {text}", 1)
    return old, new


def native_parser() -> Parser:
    p = Parser(prog="tracemill", description="Merge tracefiles into one, one section per source.")
    p.add_argument("inputs", nargs="+")
    p.add_argument("-o", "--output", required=True)
    p.add_argument("--rebase", action="append", type=_pair, default=[])
    p.add_argument("--prefix-strip")
    for name in ("--include", "--exclude"):
        p.add_argument(name, action="append", default=[])
    p.add_argument("--branch-coverage", choices=("on", "off"), default="on")
    for name in ("--no-function-data", "--strict-checksum", "--warn-unknown", "--stats"):
        p.add_argument(name, action="store_true")
    p.add_argument("-q", "--quiet", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    for names in (("--mem-limit",), ("-j", "--jobs"), ("--tmpdir",)):
        p.add_argument(*names, help="accepted without effect")
    p.add_argument("--version", action="version", version=__version__)
    return p


def compat_parser() -> Parser:
    p = Parser(prog="tracemill --compat", description="Merge tracefiles, one section per source and testcase.")
    p.add_argument("-a", "--add-tracefile", action="append", default=[])
    p.add_argument("inputs", nargs="*")
    p.add_argument("-o", "--output-file", "--output", dest="output", default="-")
    for name in ("--include", "--exclude", "--ignore-errors", "--rc"):
        p.add_argument(name, action="append", default=[])
    for name in ("function", "branch"):
        p.add_argument(f"--{name}-coverage", action="store_true")
        p.add_argument(f"--no-{name}-coverage", action="store_true")
    # of these the last one counts
    p.add_argument("--mcdc-coverage", action="store_true", default=None)
    p.add_argument("--no-mcdc-coverage", action="store_false", dest="mcdc_coverage")
    p.add_argument("--checksum", action="store_true")
    p.add_argument("--no-checksum", action="store_true")
    for name in ("--forget-test-names", "--keep-going"):
        p.add_argument(name, action="store_true")
    p.add_argument("--config-file")
    for names in (("--tempdir",), ("--mem-limit",)):
        p.add_argument(*names, help="accepted without effect")
    p.add_argument("-j", "--parallel", nargs="?", const="0", help="accepted without effect")
    return p


def compat_options(a: argparse.Namespace) -> compat.Options:
    """Settings file, then --rc, then flags; the first include, exclude or ignore-errors of the command line clears those of the file."""
    settings = read_settings(a.config_file or discover()) if a.config_file or discover() else []
    settings += [_pair(x) for x in a.rc]
    values: dict = {}
    lists: dict[str, list[str]] = {"include": [], "exclude": [], "ignore_errors": []}
    for key, value in settings:
        refuse_unsupported(key)
        if key in lists:
            lists[key].append(value)
        elif SETTINGS.get(key):
            values[SETTINGS[key]] = boolean(value)
    for key, given in (("include", a.include), ("exclude", a.exclude), ("ignore_errors", a.ignore_errors)):
        if given:
            lists[key] = given
    for name, option in (("function_coverage", "functions"), ("branch_coverage", "branches"), ("checksum", "checksum")):
        if getattr(a, name):
            values[option] = True
        if getattr(a, f"no_{name}"):
            values[option] = False
    if a.mcdc_coverage is not None:
        values["mcdc"] = a.mcdc_coverage
    if a.forget_test_names:
        values["forget_names"] = True
    ignored = frozenset(k.strip() for text in lists["ignore_errors"] for k in text.split(",") if k.strip())
    if unknown := ignored - compat.IGNORABLE:
        raise InputError(f"can't ignore: {', '.join(sorted(unknown))}", 1)
    return compat.Options(PathRules(includes=tuple(lists["include"]), excludes=tuple(lists["exclude"])), ignore=ignored, keep_going=a.keep_going, **values)


def main(argv: list[str], spark: SparkSession | None = None) -> int:
    try:
        if "--compat" in argv:
            a = compat_parser().parse_args([x for x in argv if x != "--compat"])
            options = compat_options(a)
            names = expand_globs([*a.add_tracefile, *a.inputs])
            if not names:
                raise InputError("no input", 1)
            check_regular([x for x in names if x != "-"])
            spark = spark or SparkSession.builder.appName("tracemill").getOrCreate()
            names = stage_stdin(names, folder=scratch_path(spark, "stdin"))
            plan = compat.CompatMerge(spark, names, options)
            for kind, message, n in plan.check():
                sys.stderr.write(f"tracemill: ignored {kind}: {message} ({n})\n")
            if a.output == "-":
                for row in plan.ordered().toLocalIterator():
                    sys.stdout.write(row.line + "\n")
            else:
                native.write_ordered(plan.ordered(), a.output)
            clear_scratch(spark)
            return 0
        a = native_parser().parse_args(argv)
        options = native.Options(PathRules(tuple(a.rebase), a.prefix_strip, tuple(a.include), tuple(a.exclude)), a.branch_coverage == "on", not a.no_function_data, a.strict_checksum, a.warn_unknown)
        spark = spark or SparkSession.builder.appName("tracemill").getOrCreate()
        return native.run(spark, a.inputs, a.output, options, a.quiet, a.stats)
    except (InputError, native.TraceError, compat.CompatError) as e:
        sys.stderr.write(f"tracemill: {e}\n")
        return e.status


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
