"""Features of source code as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpuslens.functions import text as T

# ---- fixed values: the patterns and word lists that define the features -------------------------

CALL = r"\w+\s*\("
CONDITION = r"\b(if|else|elif|switch|while|for)\b"
POINTER = r"\*|->"
ALLOCATION = r"\b(new|malloc|calloc)\b"
THREADING = r"(?i)\b(mutex|lock|thread)\b"

FEATURES = {
    "callback": r"(?i)(create_subscription|create_timer|create_wall_timer|Callback|callback_group|timer_callback)",
    "pub_sub": r"(?i)(create_publisher|create_subscription|advertise|subscribe|Publisher|Subscriber|publish\()",
    "lifecycle": r"(?i)(on_activate|on_deactivate|on_cleanup|on_shutdown|LifecycleNode|on_configure)",
    "parameter": r"(?i)(declare_parameter|get_parameter|set_parameter|param\(|getParam|setParam)",
    "service": r"(?i)(create_service|create_client|ServiceServer|ServiceClient|advertiseService)",
    "action": r"(?i)(create_action|ActionServer|ActionClient|action_server|action_client)",
    "tf": r"(?i)(TransformBroadcaster|TransformListener|lookupTransform|tf2|sendTransform)",
    "threading": r"(?i)(MultiThreadedExecutor|mutex|lock_guard|unique_lock|thread|boost::thread|scoped_lock)",
    "memory_mgmt": r"(?i)(new\s|delete\s|malloc|free|shared_ptr|unique_ptr|make_shared|allocat)",
    "ros_init": r"(?i)(rclcpp::init|rclpy\.init|ros::init|Node\(|rclcpp::Node)",
    "error_handling": r"(?i)(try|catch|throw|except|RCLCPP_ERROR|RCLCPP_WARN|ROS_ERROR|ROS_WARN)",
    "smart_ptr": r"(?i)(shared_ptr|unique_ptr|weak_ptr|make_shared|make_unique)",
}

#: Pairs (needed, excused by): a snippet has the anti-pattern if every needed pattern and no excuse occurs.
ANTIPATTERNS = {
    "missing_null_check": ([r"->|(\*\w+)"], r"(?i)if[^\n]*null|if[^\n]*ptr|nullptr|NULL\b|==\s*0\b"),
    "missing_lock": ([r"[Cc]allback|_cb\b", r"this->|self\.|_\w+\s*="], r"(?i)mutex|lock_guard|unique_lock|scoped_lock"),
    "raw_pointer_no_raii": ([r"\bnew\s+\w+"], r"shared_ptr|unique_ptr|make_shared|make_unique"),
    "no_bounds_check": ([r"\w+\["], r"(?i)\.size\(\)|\.length|size\(|bounds|range|\.at\("),
    "missing_input_validation": ([r"get_parameter|subscribe|msg->|msg\."], r"(?i)if\s*\([^\n]*[><]|check|valid|assert|throw|verify"),
}
BARE_CALL = r"^[a-zA-Z_]\w*(::\w+)*\s*\("
CONTROL = r"^(if|while|for|return|switch|else)"

RISKY_C = {"strcpy": "CWE-119", "strcat": "CWE-119", "sprintf": "CWE-119", "gets": "CWE-119", "scanf": "CWE-119", "memcpy": "CWE-119", "system": "CWE-78", "popen": "CWE-78", "exec": "CWE-78", "malloc": "CWE-401", "new": "CWE-401", "free": "CWE-416", "delete": "CWE-416", "printf": "CWE-134", "fprintf": "CWE-134"}
RISKY_PYTHON = {"os.system": "CWE-78", "subprocess.call": "CWE-78", "eval": "CWE-78", "exec": "CWE-78", "printf": "CWE-134", "format": "CWE-134"}
NULL_CHECKS = ("nullptr", "NULL", "!= NULL", "is None")
BOUNDS_CHECKS = ("sizeof", "strlen", "size()", ".length()")
PYTHON_SIGNALS = ("def ", "import ", "    ", "self.", "elif ")

ASAN = ("stack-buffer-overflow", "heap-buffer-overflow", "global-buffer-overflow", "heap-use-after-free", "stack-use-after-return", "stack-use-after-scope", "double-free", "AddressSanitizer: SEGV", "AddressSanitizer: null")
TSAN = ("ThreadSanitizer: data race", "ThreadSanitizer: deadlock")
UBSAN = ("runtime error: signed integer overflow", "runtime error: unsigned integer overflow", "runtime error: shift", "runtime error: division by zero", "runtime error: load of value", "runtime error: store to null pointer", "runtime error: load of null pointer")
LEAKS = ("LeakSanitizer: detected memory leaks", "Direct leak of")
RESIDUAL = ("stack-buffer-overflow", "heap-buffer-overflow", "use-after-free", "detected memory leaks", "data race", "heap-use-after-free", "segmentation fault", "segfault")

SECURITY_WORDS = ("cve-", "security fix", "vulnerability", "buffer overflow", "stack overflow", "heap overflow", "use-after-free", "use after free", "memory leak", "null pointer", "null dereference", "integer overflow", "format string", "race condition", "data race", "out of bounds", "out-of-bounds", "arbitrary code", "remote code execution", "privilege escalation", "fix crash", "fix: crash", "fix null", "fix memory", "fix leak", "fix overflow", "fix race", "sanitizer", "asan", "tsan", "ubsan")
NOISE_WORDS = ("merge pull request", "merge branch", "merge remote", "bump version", "update changelog", "update readme", "update documentation", "refactor", "cmake", "ci:", "[ci]", "clang-format", "typo", "lint", "style:", "chore:", "docs:", "test:", "revert:")

TARGET_CLASSES = ("CWE-119", "CWE-401", "CWE-362", "CWE-476", "CWE-416", "CWE-190", "CWE-134", "CWE-78")
#: Class guessed from words in the code, first match wins, and the class if none matches.
GUESSES = ((("null", "nullptr", "->"), "CWE-476"), (("malloc", "new ", "alloc"), "CWE-401"), (("memcpy", "strcpy", "sprintf"), "CWE-119"), (("mutex", "lock", "thread"), "CWE-362"))
GUESS_ELSE = "CWE-476"

# ---- expressions -----------------------------------------------------------------------------------


def any_of(x: Column, words) -> Column:
    """Whether any of the words occurs in x."""
    out = F.lit(False)
    for w in words:
        out = out | x.contains(w)
    return out


def first_of(x: Column, words) -> Column:
    """The first of the words that occurs in x, null if none does."""
    return F.coalesce(*(F.when(x.contains(w), F.lit(w)) for w in words))


def nesting(x: Column) -> Column:
    """Deepest nesting of braces, by one fold over them; a closing brace without an opening one is ignored."""
    braces = F.split(F.regexp_replace(x, "[^{}]", ""), "")
    zero = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def step(acc, b):
        now = F.when(b == "{", acc["now"] + 1).when(b == "}", F.greatest(acc["now"] - 1, F.lit(0))).otherwise(acc["now"])
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(braces, zero, step, lambda a: a["most"])


def metrics(x: Column) -> dict[str, Column]:
    """The complexity metrics by name."""
    n = lambda p: F.regexp_count(x, F.lit(p)).cast("int")
    source = F.filter(F.transform(T.lines(x), T.strip), lambda l: (l != "") & ~l.startswith("#") & ~l.startswith("//"))
    return {
        "loc": T.line_count(x),
        "sloc": F.size(source),
        "num_calls": n(CALL),
        "max_nesting": nesting(x),
        "num_conditions": n(CONDITION),
        "cyclomatic": n(CONDITION) + 1,
        "num_pointers": n(POINTER),
        "has_allocation": x.rlike(ALLOCATION),
        "has_threading": x.rlike(THREADING),
    }


def features(x: Column, registry: dict[str, str] = FEATURES) -> dict[str, Column]:
    return {name: x.rlike(pattern) for name, pattern in registry.items()}


def antipatterns(x: Column) -> dict[str, Column]:
    out = {}
    for name, (needed, excuse) in ANTIPATTERNS.items():
        has = F.lit(True)
        for pattern in needed:
            has = has & x.rlike(pattern)
        out[name] = has & ~x.rlike(excuse)
    bare = F.filter(F.transform(T.lines(x), T.strip), lambda l: l.rlike(BARE_CALL) & ~l.rlike(CONTROL))
    out["unchecked_return"] = F.size(bare) >= 2
    return out


def language_guess(x: Column) -> Column:
    """Python if two of its signals occur, else C++."""
    n = sum((x.contains(s).cast("int") for s in PYTHON_SIGNALS), F.lit(0))
    return F.when(n >= 2, "Python").otherwise("C++")


def risky_calls(x: Column, language: Column) -> Column:
    """Array of (function, risk) of called names that contain a risky name, in order of the text and the registry."""
    calls = F.regexp_extract_all(x, F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\s*\("), F.lit(1))

    def of(registry):
        names = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(c).alias("risk")) for n, c in registry.items()))
        return F.flatten(F.transform(calls, lambda c: F.transform(F.filter(names, lambda r: F.lower(c).contains(r["n"])), lambda r: F.struct(c.alias("function"), r["risk"].alias("risk")))))

    return F.when(language == "Python", of(RISKY_PYTHON)).otherwise(of(RISKY_C))


#: The lines of the text on a snippet's structure.
STRUCTURE_LINES = {
    "head": "=== Code Structure Analysis ===",
    "risky": "\u26a0 DANGEROUS OPERATIONS FOUND:",
    "none": "\u2713 No known dangerous function calls detected",
    "parameters": "Parameters (potential external input): ",
    "guards": "Defensive checks: ",
    "no_guards": "NONE detected",
    "null": "null check present",
    "bounds": "bounds check present",
    "loc": "Lines of code: ",
    "end": "=== End Analysis ===",
}


def parameters(x: Column) -> Column:
    """Parts of the first list in brackets of at most 200 characters, stripped, empty ones left out."""
    return F.filter(F.transform(F.split(F.regexp_extract(x, r"\(([^)]{0,200})\)", 1), ","), T.strip), lambda p: p != "")


def structure_text(x: Column, language: Column) -> Column:
    """Text on a snippet's structure for a prompt: up to five risky calls, up to three parameters, the checks found and the lines."""
    s, risky = STRUCTURE_LINES, risky_calls(x, language)
    calls = F.transform(F.slice(risky, 1, 5), lambda r: F.concat(F.lit("  - "), r["function"], F.lit("() \u2192 risk: "), r["risk"]))
    first = F.when(F.size(risky) > 0, F.concat_ws("\n", F.lit(s["risky"]), calls)).otherwise(s["none"])
    given = F.slice(parameters(x), 1, 3)
    params = F.when(F.size(given) > 0, F.concat(F.lit(s["parameters"]), F.array_join(given, ", ")))
    guards = F.concat_ws(", ", F.when(any_of(x, NULL_CHECKS), s["null"]), F.when(any_of(x, BOUNDS_CHECKS), s["bounds"]))
    checks = F.concat(F.lit(s["guards"]), F.when(guards == "", s["no_guards"]).otherwise(guards))
    return F.concat_ws("\n", F.lit(s["head"]), first, params, checks, F.concat(F.lit(s["loc"]), T.line_count(x).cast("string")), F.lit(s["end"]))


def compile_failed(log: Column, exit_code: Column) -> Column:
    """Whether a build failed: an error in its log and an exit code other than 0, but no report of the address sanitizer."""
    return F.coalesce(log.contains("error:") & (exit_code != 0) & ~log.contains("AddressSanitizer"), F.lit(False))


#: Issues of the static analyser that count, issues that never do, and the classes they stand for.
GATE_SEVERITIES = ("error", "warning")
GATE_EXCLUDED = ("noValidConfiguration",)
ISSUE_CLASSES = {
    "nullPointer": "CWE-476",
    "nullPointerRedundantCheck": "CWE-476",
    "possibleNullPointerArithmetic": "CWE-476",
    "bufferOverflow": "CWE-119",
    "bufferAccessOutOfBounds": "CWE-119",
    "outOfBounds": "CWE-119",
    "stringLiteralWritten": "CWE-119",
    "arrayIndexOutOfBounds": "CWE-119",
    "memleakOnRealloc": "CWE-401",
    "memleak": "CWE-401",
    "resourceLeak": "CWE-401",
    "doubleFree": "CWE-416",
    "deallocDealloc": "CWE-416",
    "danglingPointer": "CWE-416",
    "integerOverflow": "CWE-190",
    "signedIntegerOverflow": "CWE-190",
    "unsignedLessThanZero": "CWE-190",
}


def sanitizer_flags(log: Column) -> dict[str, Column]:
    """Which sanitizers a log shows, and the first keyword in the order address, thread, undefined, leak."""
    keys = {"asan": first_of(log, ASAN), "tsan": first_of(log, TSAN), "ubsan": first_of(log, UBSAN), "leak": first_of(log, LEAKS)}
    return {k: v.isNotNull() for k, v in keys.items()} | {"keyword": F.coalesce(*keys.values())}


def still_vulnerable(log: Column) -> Column:
    """Whether a log shows a memory or race error; warnings and linker errors don't count."""
    return any_of(F.lower(log), RESIDUAL)


def security_message(x: Column) -> Column:
    """Whether a commit message is on a security fix; noise words win over security words."""
    low = F.lower(x)
    return ~any_of(low, NOISE_WORDS) & any_of(low, SECURITY_WORDS)


def language_of_path(path: Column) -> Column:
    return F.when(path.rlike(r"\.(c|cpp|cc|cxx|h|hpp)$"), "C++").when(path.rlike(r"\.py$"), "Python")


def named_class(x: Column) -> Column:
    """The first target class, in registry order, that a text names; a longer number is no match."""
    up = F.upper(x)
    return F.coalesce(*(F.when(up.rlike(f"{c}([^0-9]|$)"), F.lit(c)) for c in TARGET_CLASSES))


def guessed_class(code: Column) -> Column:
    low, out = F.lower(code), None
    for words, cls in GUESSES:
        out = F.when(any_of(low, words), cls) if out is None else out.when(any_of(low, words), cls)
    return out.otherwise(GUESS_ELSE)


def version_of_repo(repo: Column) -> Column:
    """ROS generation by the repository's name."""
    low = F.lower(repo)
    return F.when(low.contains("ros2"), "ROS2").when(repo.startswith("ros/"), "ROS1").when(repo.startswith("gazebosim/"), "ROS2").when(repo == "osrf/gazebo", "ROS1").otherwise("other")


def url_parts(url: Column) -> dict[str, Column]:
    """owner, repo and sha of a commit address."""
    pattern = r"^[a-z]+://[^/]+/([^/]+)/([^/]+)/commit/([0-9a-f]+)"
    return {n: F.nullif(F.regexp_extract(url, pattern, i), F.lit("")) for i, n in enumerate(("owner", "name", "sha"), 1)}
