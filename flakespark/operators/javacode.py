"""Java sources: methods, an approximate syntax profile and its distance."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flakespark.functions.text import col

#: Names that mark assertions and the APIs a test touches.
ASSERTIONS = [
    "assertEquals", "assertNotEquals", "assertTrue", "assertFalse",
    "assertNull", "assertNotNull", "assertSame", "assertNotSame",
    "assertArrayEquals", "assertThrows", "assertDoesNotThrow",
    "assertThat", "assertAll", "fail",
    "is", "equalTo", "hasItem", "containsString",
    "isEqualTo", "isNotNull", "contains", "hasSize",
]
NETWORK = [
    "HttpClient", "HttpURLConnection", "URL", "Socket", "ServerSocket",
    "DatagramSocket", "InetAddress", "HttpRequest", "HttpResponse",
    "RestTemplate", "WebClient", "OkHttpClient", "CloseableHttpClient",
    "connect", "openConnection", "getInputStream", "getOutputStream",
]
FILES = [
    "File", "Path", "Files", "FileInputStream", "FileOutputStream",
    "BufferedReader", "BufferedWriter", "FileReader", "FileWriter",
    "RandomAccessFile", "FileChannel", "DirectoryStream",
    "createFile", "createDirectory", "delete", "exists", "readAllBytes",
]
THREADS = [
    "Thread", "Runnable", "Callable", "Future", "CompletableFuture",
    "ExecutorService", "Executors", "ThreadPoolExecutor",
    "Lock", "ReentrantLock", "Semaphore", "CountDownLatch", "CyclicBarrier",
    "synchronized", "wait", "notify", "notifyAll", "join",
    "AtomicInteger", "AtomicBoolean", "ConcurrentHashMap",
]
TIMES = [
    "sleep", "wait", "timeout", "Timeout", "Duration",
    "System.currentTimeMillis", "System.nanoTime",
    "Instant", "LocalDateTime", "ZonedDateTime",
    "ScheduledExecutorService", "Timer", "TimerTask",
    "awaitTermination", "awaitility",
]
#: What stands for missing code, and after code that was cut at so many characters.
NOT_AVAILABLE, CUT_MARK, FALLBACK = "// Test code not available", "\n// ... (code truncated)", 3000

_LEX = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|@\s*[A-Za-z_][\w.]*|[A-Za-z_$][\w$]*|\d[\w.]*|[{}()\[\];,.<>=!&|+\-*/^%?:~]', re.S)
_KEYWORDS = frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while var".split())

SETS = ["annotations", "calls", "created", "caught", "imports", "assertions", "types"]
COUNTS = ["n_calls", "n_created", "n_loops", "n_branches", "n_try", "n_catch", "n_assertions", "n_returns", "n_variables", "n_lambdas", "n_throws"]
FLAGS = ["uses_network", "uses_files", "uses_threads", "uses_time"]
PROFILE = ", ".join([f"{s} array<string>" for s in SETS] + [f"{c} int" for c in COUNTS] + [f"{f} boolean" for f in FLAGS])


def profile(source: str | None) -> dict:
    """Counts from a lexer, not a parser: exact for keywords, literals, annotations and `new`; calls are names before '('."""
    sets: dict[str, set] = {s: set() for s in SETS}
    n = dict.fromkeys(COUNTS, 0)
    tokens = [t for t in _LEX.findall(source or "") if not t.startswith(("//", "/*"))]
    simple = lambda k: tokens[k] if 0 <= k < len(tokens) else ""
    word = re.compile(r"[A-Za-z_$][\w$]*$")
    for k, t in enumerate(tokens):
        before, after = simple(k - 1), simple(k + 1)
        if t.startswith("@"):
            sets["annotations"].add(t[1:].strip())
        elif t in ("for", "while", "do"):
            n["n_loops"] += 1
        elif t in ("if", "switch", "case"):
            n["n_branches"] += t != "case"
        elif t in ("try", "catch", "return", "throw"):
            n[{"try": "n_try", "catch": "n_catch", "return": "n_returns", "throw": "n_throws"}[t]] += 1
            if t == "catch" and after == "(":
                sets["caught"].add(simple(k + 2))
        elif t == "import":
            name, j = "", k + 1
            while j < len(tokens) and tokens[j] != ";":
                name, j = name + tokens[j], j + 1
            sets["imports"].add(name)
        elif t == "new" and word.match(after):
            n["n_created"] += 1
            sets["created"].add(after)
        elif t == "-" and after == ">":
            n["n_lambdas"] += 1
        elif word.match(t) and t not in _KEYWORDS and not t.startswith('"'):
            if after == "(" and before != "new" and not word.match(before or "(") or after == "(" and before in ("return", "else", "throw"):
                n["n_calls"] += 1
                sets["calls"].add(t)
                if t in ASSERTIONS or t.startswith("assert"):
                    n["n_assertions"] += 1
                    sets["assertions"].add(t)
            elif word.match(before or "(") and before not in ("new", "return", "import", "package", "class", "extends", "implements", "throws") and after in ("=", ";"):
                n["n_variables"] += 1
                sets["types"].add(before)
    used = sets["calls"] | sets["created"] | ({"synchronized"} if "synchronized" in tokens else set())
    flags = {"uses_network": bool(used & set(NETWORK)), "uses_files": bool(used & set(FILES)), "uses_threads": bool(used & set(THREADS)), "uses_time": bool(sets["calls"] & set(TIMES))}
    return {s: sorted(x for x in v if x) for s, v in sets.items()} | n | flags


#: What may stand between a method's parameters and its body; possessive, so nothing is tried twice.
_BODY = re.compile(r"\s*+(?:throws\s[\w,.\s]*+)?\{")
_MARK = re.compile(r'\\.|["{}]', re.S)
_TYPE = re.compile(r"[\w<>\[\].?]++$")
_NO_TYPE = ("new", "return", "else", "throw")


def _declared(source: str, method: str) -> tuple[int, int] | None:
    """Begin of the type and place of the body of the first declaration of a method; one walk over the source."""
    close, body = -1, None
    for name in re.finditer(r"\b" + re.escape(method) + r"\s*+\(", source):
        if close < name.end():
            close = source.find(")", name.end())
            if close < 0:
                return None
            body = _BODY.match(source, close + 1)
        k = name.start() - 1
        while k >= 0 and source[k].isspace():
            k -= 1
        type_name = _TYPE.search(source, max(0, k - 200), k + 1) if body and 0 <= k < name.start() - 1 else None
        if type_name and type_name.group() not in _NO_TYPE:
            return type_name.start(), body.end() - 1
    return None


def method_of(source: str | None, name: str | None) -> str:
    """The text of the method that a test name names, with up to five lines of annotations and comments before it."""
    if not source:
        return NOT_AVAILABLE
    method = (name or "").replace("#", ".").rpartition(".")[2]
    found = _declared(source, method) if method else None
    if found:
        depth, k, quoted = 0, found[1], False
        for mark in _MARK.finditer(source, found[1]):
            c = mark.group()
            if c == '"':
                quoted = not quoted
            elif not quoted and c in "{}":
                depth += 1 if c == "{" else -1
                if not depth:
                    k = mark.start()
                    break
        else:
            k = len(source)
        begin = source.rfind("\n", 0, found[0]) + 1
        for _ in range(5):
            above = source.rfind("\n", 0, max(begin - 1, 0)) + 1
            line = source[above : max(begin - 1, 0)].strip()
            if begin == 0 or line and not line.startswith(("@", "//", "*", "/*")):
                break
            begin = above
        return source[begin : k + 1].strip("\n")
    return source if len(source) <= FALLBACK else source[:FALLBACK] + CUT_MARK


def _methods(source: pd.Series, name: pd.Series) -> pd.Series:
    return pd.Series([method_of(s, n) for s, n in zip(source, name)])


def _profiles(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([profile(s) for s in source], columns=[*SETS, *COUNTS, *FLAGS])


def extract_method(source: Column | str, name: Column | str) -> Column:
    return F.pandas_udf(_methods, "string")(col(source), col(name))


def ast_features(source: Column | str) -> Column:
    return F.pandas_udf(_profiles, PROFILE)(col(source))


def _set_distance(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).when((F.size(a) == 0) | (F.size(b) == 0), 1.0).otherwise(1 - F.size(F.array_intersect(a, b)) / F.nullif(both, F.lit(0)))


def distance_vector(a: str, b: str) -> Column:
    """15 distances of two profiles: 6 Jaccard, 5 scaled count differences, 4 flags."""
    x = lambda side, f: F.col(f"{side}.{f}")
    sets = [_set_distance(x(a, f), x(b, f)) for f in SETS[:6]]
    counts = [F.when(F.greatest(x(a, f), x(b, f)) == 0, 0.0).otherwise(F.abs(x(a, f) - x(b, f)) / F.nullif(F.greatest(x(a, f), x(b, f)), F.lit(0))) for f in ("n_calls", "n_created", "n_loops", "n_branches", "n_assertions")]
    flags = [(x(a, f) != x(b, f)).cast("double") for f in FLAGS]
    return F.array(*sets, *counts, *flags)


def ast_distances(rows: DataFrame, block: list[str], key: str, features: str) -> DataFrame:
    """Distance vectors of the pairs of a block."""
    left = rows.select(*block, F.col(key).alias("a"), F.col(features).alias("fa"))
    right = rows.select(*block, F.col(key).alias("b"), F.col(features).alias("fb"))
    return left.join(right, block).where("a < b").select(*block, "a", "b", distance_vector("fa", "fb").alias("distances"))
