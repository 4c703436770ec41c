"""Settings files of the testcase-preserving merge: ``key = value`` lines, environment references, nested files."""

from __future__ import annotations

import os
import re

from tracemill.sources.inputs import InputError

MAX_DEPTH = 32
_TRUE, _FALSE = ("1", "on", "yes", "true"), ("0", "off", "no", "false")

# fixed values: settings of the format's tools that would change a merge and have no counterpart here
REFUSED = frozenset("""
memory memory_percentage source_directory build_directory substitute omit_lines erase_functions filter resolve_script context_script version_script compute_file_version sort_input case_insensitive path_style
stop_on_error no_exception_branch derive_function_end_line_all_files trivial_function_threshold lcov_json_module lcov_excl_line lcov_excl_br_line lcov_excl_exception_br_line lcov_excl_start lcov_excl_stop
lcov_excl_br_start lcov_excl_br_stop lcov_excl_exception_br_start lcov_excl_exception_br_stop lcov_unreachable_start lcov_unreachable_stop lcov_unreachable_line retain_unreachable_coverpoints_if_executed
ignore_unreachable_flag max_message_count message_log expected_message_count treat_warning_as_error warn_once_per_file rtl_file_extensions c_file_extensions perl_file_extensions python_file_extensions
java_file_extensions info_file_pattern filter_lookahead filter_bitwise_conditional filter_blank_aggressive profile max_fork_fails max_tasks_per_core dedicate_segment_threshold dedicate_segment_line_estimate
parallel_parse_min_lines parallel_parse_chunks_per_worker fork_fail_timeout no_branch_coverage criteria_script unreachable_script criteria_callback_data criteria_callback_levels demangle_cpp
excessive_count_threshold split_char cross_platform_read check_existence_before_callback fail_under_lines fail_under_branches lcov_filter_parallel lcov_filter_chunk_size
""".split())


def refuse_unsupported(key: str) -> None:
    """Settings that would change the result may not be passed over in silence; unknown ones are ignored."""
    if key in REFUSED:
        raise InputError(f"the setting {key} isn't supported", 1)


def boolean(text: str) -> bool:
    word = text.strip().lower()
    if word in _TRUE or word in _FALSE:
        return word in _TRUE
    raise InputError(f"not a truth value: {text}", 1)


def size(text: str) -> int:
    """Bytes, with K, M or G as a suffix."""
    m = re.fullmatch(r"([0-9]+)([KMG]?)", text.strip(), re.I)
    if not m:
        raise InputError(f"not a size: {text}", 1)
    return int(m[1]) << {"": 0, "K": 10, "M": 20, "G": 30}[m[2].upper()]


def interpolated(text: str) -> str:
    """``$ENV{NAME}`` stands for a variable of the environment."""

    def value(m: re.Match) -> str:
        if m[1] not in os.environ:
            raise InputError(f"no such variable: {m[1]}", 1)
        return os.environ[m[1]]

    return re.sub(r"\$ENV\{([^}]*)\}", value, text)


def read_settings(path: str, seen: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(key, value) in order; ``config_file`` includes another file, which may not include itself."""
    real = os.path.realpath(path)
    if real in seen or len(seen) >= MAX_DEPTH:
        raise InputError(f"settings files include each other: {path}", 1)
    try:
        with open(path, encoding="utf-8") as f:
            lines = f.read().splitlines()
    except OSError as e:
        raise InputError(f"can't read {path}: {e.strerror}", 1) from e
    found: list[tuple[str, str]] = []
    for line in lines:
        line = line.split("#", 1)[0].strip()
        if not line:
            continue
        key, equals, value = (x.strip() for x in line.partition("="))
        if not equals:
            raise InputError(f"{path}: not a setting: {line}", 1)
        value = interpolated(value)
        if key == "config_file":
            found += read_settings(os.path.join(os.path.dirname(path), value), (*seen, real))
        else:
            found.append((key, value))
    return found


def discover() -> str | None:
    """The settings file used if none is named: in the home folder, then the system's."""
    for path in (os.path.join(os.path.expanduser("~"), ".lcovrc"), "/etc/lcovrc"):
        if os.path.isfile(path):
            return path
    return None
