"""From parameters to sinks: taint through Python functions and their helpers, and patterns of JavaScript; file links.

A parameter of a function is a source. Taint goes through assignments, loops, with, walrus, calls and string building;
helpers of the same component are followed three deep. Sinks are of eight kinds; a check that confines a path or
a host drops the finding, quoting lowers its confidence.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.units import bracket_end, canonical_path

#: How deep helpers are followed, and how many files one component may have.
DEPTH, FILES = 3, 200
_SKIP = {"self", "cls", "ctx", "context"}
# Calls that are sinks, by kind.
_CALLS = {
    "shell": {"os.system", "os.popen", "subprocess.getoutput", "subprocess.getstatusoutput", "asyncio.create_subprocess_shell"},
    "argv": {"subprocess.run", "subprocess.call", "subprocess.check_call", "subprocess.check_output", "subprocess.Popen", "asyncio.create_subprocess_exec", "os.execv", "os.execve", "os.execvp", "os.spawnv", "os.spawnl"},
    "eval": {"eval", "exec", "compile"},
    "deser": {"pickle.load", "pickle.loads", "marshal.loads", "marshal.load", "dill.loads", "dill.load", "yaml.load", "yaml.unsafe_load", "torch.load", "joblib.load"},
    "path": {"open", "os.remove", "os.unlink", "os.rename", "os.listdir", "os.makedirs", "shutil.copy", "shutil.move", "shutil.rmtree", "pathlib.Path", "Path"},
    "url": {"requests.get", "requests.post", "requests.put", "requests.delete", "requests.request", "httpx.get", "httpx.post", "urllib.request.urlopen", "urlopen"},
    "template": {"jinja2.Template", "Template", "Environment.from_string", "env.from_string"},
}
_METHODS = {"sql": {"execute", "executemany", "executescript", "raw", "read_sql", "read_sql_query"}, "path": {"read_text", "write_text", "read_bytes", "write_bytes"}}
_QUOTING = {"shlex.quote", "quote", "shlex.join", "escape_shell_arg"}
_CONFINING = {"is_relative_to", "relative_to", "commonpath", "realpath", "secure_filename"}


def _dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else parts[0] if parts else ""


class _Function:
    """One pass over a function: which names are tainted by which parameters, and which sinks they reach."""

    def __init__(self, node: ast.AST, helpers: dict[str, ast.AST], imports: dict[str, str], depth: int, stack: tuple[str, ...]) -> None:
        self.helpers, self.imports, self.depth, self.stack = helpers, imports, depth, stack
        args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
        self.params = [a.arg for a in args if a.arg not in _SKIP]
        self.taint: dict[str, set[str]] = {p: {p} for p in self.params}
        self.quoted: set[str] = set()
        self.confined = {_dotted(n.func).split(".")[-1] for n in ast.walk(node) if isinstance(n, ast.Call)} & _CONFINING
        self.returns: set[str] = set()
        self.found: set[tuple[str, str, int, str]] = set()
        body = node.body if isinstance(node.body, list) else [node.body]
        for _ in range(2):  # a second round carries taint around loops
            for s in body:
                self.visit(s)

    def of(self, node: ast.AST | None) -> set[str]:
        """The parameters that an expression holds."""
        if node is None:
            return set()
        if isinstance(node, ast.Name):
            return set(self.taint.get(node.id, ()))
        if isinstance(node, ast.Call):
            return self.call(node)
        if isinstance(node, ast.NamedExpr):
            got = self.of(node.value)
            self.assign(node.target, got)
            return got
        if isinstance(node, (ast.Constant, ast.Lambda)):
            return set()
        out: set[str] = set()
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.comprehension):
                self.assign(child.target, self.of(child.iter))
            out |= self.of(child)
        return set() if isinstance(node, ast.Compare) else out

    def assign(self, target: ast.AST, got: set[str]) -> None:
        if isinstance(target, ast.Name):
            self.taint[target.id] = self.taint.get(target.id, set()) | got
        elif isinstance(target, (ast.Tuple, ast.List)):
            for t in target.elts:
                self.assign(t, got)
        elif isinstance(target, (ast.Attribute, ast.Subscript, ast.Starred)):
            self.assign(target.value, got)

    def call(self, node: ast.Call) -> set[str]:
        name = _dotted(node.func)
        full = self.imports.get(name.split(".")[0], name.split(".")[0]) + name[len(name.split(".")[0]) :] if name else ""
        values = [*node.args, *[k.value for k in node.keywords]]
        held = [self.of(v) for v in values]
        all_held = set().union(*held) if held else set()
        receiver = self.of(node.func.value) if isinstance(node.func, ast.Attribute) else set()
        if full in _QUOTING or name.split(".")[-1] in ("quote", "escape"):
            self.quoted |= all_held
            return all_held
        if name in ("int", "float", "bool", "len"):
            return set()
        shell = any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords)
        for kind, calls in _CALLS.items():
            if full in calls or name in calls:
                reach = held[0] if held else set()
                if kind == "argv" and shell:
                    kind = "shell"
                if kind == "deser" and "yaml.load" in full and any("Safe" in ast.dump(v) for v in values):
                    continue
                if kind == "path" and self.confined:
                    continue
                if kind == "url" and node.args and isinstance(node.args[0], ast.JoinedStr) and node.args[0].values and isinstance(node.args[0].values[0], ast.Constant) and re.match(r"https?://[^/]+/", str(node.args[0].values[0].value)):
                    continue
                self.hit(kind, reach, node.lineno)
        last = name.split(".")[-1]
        if isinstance(node.func, ast.Attribute):
            if last in _METHODS["sql"] and node.args and not isinstance(node.args[0], (ast.Constant, ast.Name)):
                self.hit("sql", held[0], node.lineno)
            elif last in _METHODS["sql"] and node.args and isinstance(node.args[0], ast.Name) and node.args[0].id not in self.params:
                self.hit("sql", held[0], node.lineno)
            if last in _METHODS["path"] and not self.confined:
                self.hit("path", receiver, node.lineno)
        helper = self.helpers.get(full) or self.helpers.get(name)
        if helper is not None and self.depth < DEPTH and full not in self.stack:
            inner = _Function(helper, self.helpers, self.imports, self.depth + 1, (*self.stack, full))
            by_param = dict(zip(inner.params, held, strict=False)) | {k.arg: self.of(k.value) for k in node.keywords if k.arg}
            for param, kind, _, confidence in inner.found:
                for source in by_param.get(param, ()):
                    self.found.add((source, kind, node.lineno, "medium" if source in self.quoted else confidence))
            return set().union(*(by_param.get(p, set()) for p in inner.returns)) if inner.returns else set()
        return all_held | receiver

    def hit(self, kind: str, reach: set[str], line: int) -> None:
        for p in reach:
            self.found.add((p, kind, line, "medium" if p in self.quoted and kind in ("shell", "argv") else "high"))

    def visit(self, node: ast.AST) -> None:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            return
        if isinstance(node, ast.Assign):
            got = self.of(node.value)
            for t in node.targets:
                self.assign(t, got)
        elif isinstance(node, (ast.AugAssign, ast.AnnAssign)):
            self.assign(node.target, self.of(node.value))
        elif isinstance(node, (ast.For, ast.AsyncFor)):
            self.assign(node.target, self.of(node.iter))
        elif isinstance(node, (ast.With, ast.AsyncWith)):
            for i in node.items:
                got = self.of(i.context_expr)
                if i.optional_vars:
                    self.assign(i.optional_vars, got)
        elif isinstance(node, ast.Return):
            self.returns |= self.of(node.value)
        elif isinstance(node, ast.expr):
            self.of(node)
            return
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.stmt, ast.excepthandler)) or (isinstance(child, ast.expr) and not isinstance(node, (ast.Assign, ast.AugAssign, ast.AnnAssign, ast.Return))):
                self.visit(child)


def python_taint(sources: dict[str, str]) -> list[tuple[str, str, str, str, int, str]]:
    """(path, function, parameter, kind, line, confidence) over the Python files of one component."""
    trees: dict[str, ast.Module] = {}
    for path, text in sources.items():
        try:
            trees[path] = ast.parse(text)
        except (SyntaxError, ValueError, RecursionError):
            continue
    every: dict[str, ast.AST] = {}
    for path, tree in trees.items():
        module = path.removesuffix(".py").removesuffix("/__init__").replace("/", ".")
        for node in tree.body:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                every[f"{module}.{node.name}"] = node
                every.setdefault(f"{module.split('.')[-1]}.{node.name}", node)
    out = []
    for path, tree in trees.items():
        helpers, imports = dict(every), {}
        for node in ast.walk(tree):
            if isinstance(node, ast.Import):
                imports |= {(a.asname or a.name.split(".")[0]): (a.name if a.asname else a.name.split(".")[0]) for a in node.names}
            elif isinstance(node, ast.ImportFrom) and node.module:
                imports |= {(a.asname or a.name): f"{node.module}.{a.name}" for a in node.names}
            elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                helpers[node.name] = node
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                f = _Function(node, helpers, imports, 0, (node.name,))
                out += [(path, node.name, *x) for x in f.found]
    return sorted(set(out))


_JS_FN = re.compile(r"(?:function\s+(?P<n1>\w+)\s*\((?P<p1>[^)]*)\)|(?:const|let|var)\s+(?P<n2>\w+)\s*=\s*(?:async\s*)?\((?P<p2>[^)]*)\)\s*=>|async\s*\(\s*\{?(?P<p3>[^)}]*)\}?[^)]*\)\s*=>)\s*\{")
# JavaScript sinks by kind.
_JS_SINKS = {"shell": r"\b(?:exec|execSync)\s*\(", "argv": r"\b(?:spawn|spawnSync|execFile|execFileSync|execa|fork)\s*\(", "eval": r"\beval\s*\(|new\s+Function\s*\(|\bvm\.run\w*\s*\(", "path": r"\bfs(?:\.promises)?\.\w+\s*\(|\breadFile(?:Sync)?\s*\(", "url": r"\b(?:fetch|axios(?:\.\w+)?|got|ky|https?\.(?:get|request))\s*\(", "sql": r"\.(?:query|execute|raw|unsafe)\s*\(\s*`", "template": r"\b(?:ejs\.render|Handlebars\.compile|pug\.render|nunjucks\.renderString)\s*\(", "deser": r"\b(?:unserialize|deserialize)\s*\("}


def js_taint(source: str) -> list[tuple[str, str, str, int, str]]:
    """(function, parameter, kind, line, confidence): parameters that stand in the call of a sink, over simple renamings."""
    out = []
    for m in _JS_FN.finditer(source):
        depth, i = 1, m.end()
        while i < len(source) and depth:
            depth += (source[i] == "{") - (source[i] == "}")
            i += 1
        body = source[m.end() : i]
        params = [re.split(r"[:=]", p.strip())[0].strip(" {}.?") for p in (m["p1"] or m["p2"] or m["p3"] or "").split(",")]
        for p in filter(str.isidentifier, params):
            names = {p}
            for a in re.finditer(r"(?:const|let|var)\s+(\w+)\s*=\s*([^;\n]+)", body):
                if any(re.search(rf"\b{n}\b", a[2]) for n in names):
                    names.add(a[1])
            for kind, rx in _JS_SINKS.items():
                for s in re.finditer(rx, body):
                    opened = body.rfind("(", s.start(), s.end()) + 1
                    args = body[opened : bracket_end(body, opened)]
                    if any(re.search(rf"\b{n}\b", args) for n in names) and not (kind == "path" and re.search(r"startsWith\(|path\.relative\(", body)):
                        out.append((m["n1"] or m["n2"] or "", p, "shell" if kind == "argv" and "shell: true" in args else kind, source.count("\n", 0, m.end() + s.start()) + 1, "high"))
    return sorted(set(out))


FLOWS = "path string, function string, parameter string, kind string, line int, confidence string"


def component_taint(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flows, events) of files (scan_id, component, path, language, text).

    The files of a component come together in one row; components of more than 200 files are left out and reported,
    as their calls cannot be followed at a bounded cost.
    """
    code = files.filter(F.col("language").isin("python", "javascript", "typescript") & F.col("text").isNotNull())
    sizes = code.groupBy("scan_id", "component").agg(F.count("*").alias("n"))
    events = sizes.filter(F.col("n") > FILES).select("scan_id", "component", F.lit("links_not_traced").alias("kind"))
    fit = code.join(sizes.filter(F.col("n") <= FILES).select("scan_id", "component"), ["scan_id", "component"], "left_semi")
    packed = fit.groupBy("scan_id", "component").agg(F.collect_list(F.struct("path", "language", "text")).alias("files"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for scan, component, fs in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                got = python_taint({f["path"]: f["text"] for f in fs if f["language"] == "python"})
                got += [(f["path"], *x) for f in fs if f["language"] != "python" for x in js_taint(f["text"])]
                rows += [(scan, component, *x) for x in got]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=["scan_id", "component", "path", "function", "parameter", "kind", "line", "confidence"])

    return packed.mapInArrow(run, "scan_id string, component string, " + FLOWS), events


# ---------------------------------------------------------------- links between files

_WRITES = re.compile(r"(?:>>?\s*|tee\s+(?:-a\s+)?|-o\s+|--output[= ]|open\(\s*[\"']|writeFile(?:Sync)?\(\s*[\"'`]|Path\(\s*[\"'])(?P<p>[\w./~$-]+\.\w+|/tmp/[\w.-]+)(?P<rest>[^\n]{0,40})")
_RUNS = re.compile(r"(?:^|[;&|]\s*|\b)(?:bash|sh|zsh|python3?|node|source|\.|exec)\s+(?P<p>[\w./~$-]+\.(?:sh|py|js|mjs|ts))\b", re.M)
_PATHS = re.compile(r"(?<![\w/])(?P<p>(?:~|\.{1,2}|/tmp|[\w-]+)?/?[\w./-]+\.(?:sh|py|js|mjs|ts|json|txt|env|yaml|yml|md|log|dat))\b")


def link_facts(path: str, text: str) -> list[tuple[str, str]]:
    """(fact, path) of a file: what it writes, runs, imports and mentions, in one writing."""
    out: set[tuple[str, str]] = set()
    for m in _WRITES.finditer(text):
        if not m[0].startswith(("open", "Path")) or re.search(r"[\"']\s*,\s*[\"'][wax]|write", m["rest"]):
            out.add(("writes", canonical_path(m["p"])))
    out |= {("runs", canonical_path(m["p"])) for m in _RUNS.finditer(text)}
    out |= {("mentions", canonical_path(m["p"])) for m in _PATHS.finditer(text)}
    here = path.rsplit("/", 1)[0] + "/" if "/" in path else ""
    for m in re.finditer(r"^\s*(?:from\s+\.?([\w.]+)\s+import|import\s+([\w.]+))", text, re.M):
        out.add(("imports", here + (m[1] or m[2]).strip(".").replace(".", "/") + ".py"))
    for m in re.finditer(r"(?:from|require\(|import\()\s*[\"'](\.{1,2}/[^\"']+)[\"']", text):
        target = canonical_path(here + m[1])
        out |= {("imports", target if re.search(r"\.\w+$", target) else target + ext) for ext in (".js", ".ts")}
    return sorted(out)


def file_links(files: DataFrame) -> DataFrame:
    """(component, src, dst, via) between files (component, path, text): src runs or imports dst, or writes what dst mentions.

    Facts meet by equality of the path; a path that no file has meets the file whose base name is unique in the component.
    """
    from skein.functions.units import explode_with

    packed = files.select("component", "path", F.concat("path", F.lit("\x00"), "text").alias("t"))
    facts = explode_with(packed, "t", lambda t: link_facts(*t.split("\x00", 1)), "fact string, target string")
    have = files.select("component", F.col("path").alias("target")).distinct()
    base = have.withColumn("base", F.regexp_extract("target", r"[^/]*$", 0)).groupBy("component", "base").agg(F.count("*").alias("n"), F.min("target").alias("to")).filter("n = 1")
    code = facts.filter("fact in ('runs', 'imports')")
    exact = code.join(have, ["component", "target"]).select("component", F.col("path").alias("src"), F.col("target").alias("dst"), F.when(F.col("fact") == "runs", "run").otherwise("import").alias("via"))
    loose = code.filter("fact = 'runs'").join(have, ["component", "target"], "left_anti").withColumn("base", F.regexp_extract("target", r"[^/]*$", 0)).join(base, ["component", "base"]).select("component", F.col("path").alias("src"), F.col("to").alias("dst"), F.lit("run").alias("via"))
    w = facts.filter("fact = 'writes'").select("component", F.col("path").alias("src"), "target")
    r = facts.filter("fact = 'mentions'").select("component", F.col("path").alias("dst"), "target")
    relay = w.join(r, ["component", "target"]).filter("src <> dst").select("component", "src", "dst", F.lit("file").alias("via"))
    return exact.unionByName(loose).unionByName(relay).filter("src <> dst").distinct()
