"""Rules over syntax trees: declarative patterns, matched in one parse of each file.

Python is read by its syntax tree, JavaScript, TypeScript, Go, Java and Rust by the expressions of ``brackets``; rules
of JavaScript hold for TypeScript as well. Files of other languages, and Python that does not parse, have no match.

A pattern names a node and puts predicates on its captures: ``eq`` (text equal to), ``match`` (text found by a
regular expression), ``kind`` (one of some kinds of value) and ``absent`` (no such capture). A call captures its
callee (dotted), attr (the callee's last part), arg0, arg1, .. and kw.<name>; an assignment target and value; an
import module and name; an exception handler type and body; an assert its test. The kinds of values are str,
fstring, concat, percent, format, number, name, attribute, call, subscript, list, dict, tuple, constant and other.
What is reported is the whole node, once per rule and line.
"""

from __future__ import annotations

import ast
import functools
import json
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brackets

LANGUAGES = ("Python", *brackets.LANGUAGES)
MATCHES = "file_path string, rule_id string, severity string, owasp_category string, cwe_id string, line int, column_num int, snippet string"


def dotted(node: ast.AST) -> str | None:
    """Name of a chain of attributes; calls inside it are written as ()."""
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        return f"{dotted(node.value) or '?'}.{node.attr}"
    if isinstance(node, ast.Call):
        return f"{dotted(node.func) or '?'}()"
    return None


def value(node: ast.AST) -> tuple[str, str]:
    """(kind, text) of an expression."""
    if isinstance(node, ast.Constant):
        kind = "str" if isinstance(node.value, (str, bytes)) else "number" if type(node.value) in (int, float, complex) else "constant"
        return kind, node.value if isinstance(node.value, str) else repr(node.value)
    if isinstance(node, ast.JoinedStr):
        return ("fstring" if any(isinstance(x, ast.FormattedValue) for x in node.values) else "str"), ast.unparse(node)
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Mod)):
        return ("concat" if isinstance(node.op, ast.Add) else "percent"), ast.unparse(node)
    if isinstance(node, ast.Call):
        return ("format" if isinstance(node.func, ast.Attribute) and node.func.attr == "format" else "call"), ast.unparse(node)
    kinds = {ast.Name: "name", ast.Attribute: "attribute", ast.Subscript: "subscript", ast.List: "list", ast.Dict: "dict", ast.Tuple: "tuple"}
    return kinds.get(type(node), "other"), ast.unparse(node)


def captures(node: ast.AST) -> tuple[str, list[dict[str, tuple[str, str]]]]:
    """(what the node is called in patterns, the captures of each reading of it)."""
    if isinstance(node, ast.Call):
        name = dotted(node.func) or ""
        got = {"callee": ("name", name), "attr": ("name", name.rpartition(".")[2])}
        got |= {f"arg{i}": value(a) for i, a in enumerate(node.args)}
        return "call", [got | {f"kw.{k.arg}": value(k.value) for k in node.keywords if k.arg}]
    if isinstance(node, (ast.Assign, ast.AnnAssign)) and node.value is not None:
        targets = node.targets if isinstance(node, ast.Assign) else [node.target]
        return "assign", [{"target": ("name", dotted(t) or ""), "value": value(node.value)} for t in targets]
    if isinstance(node, ast.Import):
        return "import", [{"module": ("name", a.name)} for a in node.names]
    if isinstance(node, ast.ImportFrom):
        return "import", [{"module": ("name", node.module or ""), "name": ("name", a.name)} for a in node.names]
    if isinstance(node, ast.ExceptHandler):
        got = {"body": ("other", "; ".join(map(ast.unparse, node.body)))}
        return "handler", [got | ({"type": value(node.type)} if node.type else {})]
    if isinstance(node, ast.Assert):
        return "assert", [{"test": value(node.test)}]
    return "", []


#: Captures that name a node. What rules ask of them is told once for every name of a task, up to NAMES_KEPT of at most NAME_LENGTH.
NAMES = {"call": ("callee", "attr"), "literal": ("callee", "attr"), "assign": ("target",)}
NAMES_KEPT, NAME_LENGTH = 10_000, 200


class Patterns:
    """Patterns by node, and those of calls with a fixed last name by that name."""

    def __init__(self, rules: Sequence[tuple]):
        self.by_node: dict[str, list] = defaultdict(list)
        self.by_attr: dict[str, list] = defaultdict(list)
        for rule in rules:
            p = json.loads(rule[1])
            p["match"] = {k: re.compile(x) for k, x in p.get("match", {}).items()}
            fixed = p.get("eq", {}).get("callee") or p.get("eq", {}).get("attr")
            names = NAMES.get(p["node"], ())
            named, rest = ({x: [(k, y) for k, y in p.get(x, {}).items() if (k in names) == own] for x in ("eq", "match")} for own in (True, False))
            rest |= {"kind": list(p.get("kind", {}).items()), "absent": p.get("absent", [])}
            if p["node"] == "call" and fixed:
                self.by_attr[fixed.rpartition(".")[2]].append((rule, named, rest))
            else:
                self.by_node[p["node"]].append((rule, named, rest))
        self.kept = functools.lru_cache(NAMES_KEPT)(self.named)

    def named(self, node: str, names: tuple[str, ...]) -> list[tuple]:
        """(rule, what it asks of the other captures) of the rules that fit the names of a node."""
        got = {k: ("name", x) for k, x in zip(NAMES.get(node, ()), names)}
        more = self.by_attr.get(got["attr"][1], []) if node == "call" else []
        return [(rule, rest) for rule, own, rest in [*self.by_node.get(node, []), *more] if self.fits(own, got)]

    @staticmethod
    def fits(p: dict, got: dict[str, tuple[str, str]]) -> bool:
        for k, x in p["eq"]:
            if k not in got or got[k][1] != x:
                return False
        for k, x in p["match"]:
            if k not in got or not x.search(got[k][1]):
                return False
        for k, x in p.get("kind", ()):
            if k not in got or got[k][0] not in x:
                return False
        for k in p.get("absent", ()):
            if k in got:
                return False
        return True

    def find(self, text: str | None, language: str = "Python") -> list[tuple]:
        """(rule, line, column, snippet) of a source text, in order of the tree; none if it does not parse."""
        found, seen = [], set()
        for kind, got, line, column, snippet in (nodes if language == "Python" else functools.partial(brackets.nodes, language))(text or ""):
            names = tuple([got[x][1] for x in NAMES.get(kind, ())])
            for rule, rest in (self.kept if sum(map(len, names)) <= NAME_LENGTH else self.named)(kind, names):
                if (rule[0], line) not in seen and self.fits(rest, got):
                    seen.add((rule[0], line))
                    found.append((rule, line, column, snippet()))
        return found


def nodes(text: str) -> Iterator[tuple]:
    """(node, captures, line, column, what gives its text) of a Python text that parses."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return
    for node in ast.walk(tree):
        kind, readings = captures(node)
        for got in readings:
            yield kind, got, node.lineno, node.col_offset + 1, lambda node=node: ast.get_source_segment(text, node) or ""


def applies(language: str, wanted: str | None) -> bool:
    """Do rules of a language hold for files of another? Without one they are Python's."""
    return language == (wanted or "Python") or (language == "TypeScript" and wanted == "JavaScript")


def match_trees(files: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches of tree rules in files (file_path, text) of LANGUAGES. The rules are few and go with the plan."""
    from .files import language_of, spread

    fields = ["rule_id", "tree", "severity", "owasp_category", "cwe_id", "language"]
    known = [tuple(r) for r in rules.where("tree is not null").orderBy("rule_id", "language").select(*fields).collect()]
    read = files.select("file_path", "text", language_of("file_path").alias("language")).where(F.col("language").isin(*LANGUAGES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = {x: Patterns([r for r in known if applies(x, r[5])]) for x in LANGUAGES}
        for b in batches:
            rows = [
                (path, rule[0], rule[2], rule[3], rule[4], line, column, snippet)
                for path, text, language in zip(*(c.to_pylist() for c in b.columns))
                for rule, line, column, snippet in patterns[language].find(text, language)
            ]
            kinds = [pa.string()] * 5 + [pa.int32()] * 2 + [pa.string()]
            cols = [pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 8, kinds)]
            yield pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in MATCHES.split(", ")])

    return spread(read).mapInArrow(run, MATCHES)


def self_tests(rules: DataFrame) -> DataFrame:
    """(rule_id, expected, matched) of every test case of the tree rules, each rule run on its own cases only."""
    own = F.coalesce("language", F.lit("Python")).alias("language")
    cases = rules.where("tree is not null").select("rule_id", "tree", own, F.posexplode("test_cases").alias("n", "case"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, trees, languages, codes, expected = (c.to_pylist() for c in b.columns)
            matched = [bool(Patterns([(i, t)]).find(code, x)) for i, t, x, code in zip(ids, trees, languages, codes)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(expected, pa.bool_()), pa.array(matched, pa.bool_())], names=["rule_id", "expected", "matched"])

    return cases.select("rule_id", "tree", "language", "case.code", "case.expected").mapInArrow(run, "rule_id string, expected boolean, matched boolean")


DYNAMIC = ["fstring", "concat", "percent", "format"]
OPEN_END = [*DYNAMIC, "name", "attribute", "subscript", "call"]


def _call(callee: str, **conditions) -> dict:
    return {"node": "call", "eq": {"callee": callee, **conditions.pop("eq", {})}, **conditions}


#: Rules of our own: id, name, severity, CWE, OWASP category, pattern, code that it must find, code that it must not.
TREE_RULES = [
    ("PY101", "eval of a value", "Critical", "CWE-95", "A03", _call("eval", kind={"arg0": OPEN_END}), "eval(data)", "eval('1 + 1')"),
    ("PY102", "exec of a value", "Critical", "CWE-95", "A03", _call("exec", kind={"arg0": OPEN_END}), "exec(code)", "exec('x = 1')"),
    ("PY103", "Import by a value", "Medium", "CWE-95", "A03", _call("__import__", kind={"arg0": OPEN_END}), "__import__(name)", "__import__('os')"),
    ("PY104", "Shell command", "High", "CWE-78", "A03", _call("os.system", kind={"arg0": OPEN_END}), "os.system('ls ' + path)", "os.system('ls')"),
    ("PY105", "Shell pipe", "High", "CWE-78", "A03", _call("os.popen", kind={"arg0": OPEN_END}), "os.popen(f'cat {path}')", "os.popen('date')"),
    ("PY106", "Process through a shell", "High", "CWE-78", "A03", {"node": "call", "match": {"callee": r"^subprocess\.(run|call|Popen|check_call|check_output)$"}, "eq": {"kw.shell": "True"}}, "subprocess.run(command, shell=True)", "subprocess.run(['ls'], shell=False)"),
    ("PY107", "Process replaced by a value", "High", "CWE-78", "A03", {"node": "call", "match": {"callee": r"^os\.(exec|spawn)[lv]"}, "kind": {"arg0": OPEN_END}}, "os.execv(program, args)", "os.execv('/bin/ls', ['ls'])"),
    ("PY108", "Unpickling", "High", "CWE-502", "A08", {"node": "call", "match": {"callee": r"^c?[pP]ickle\.loads?$"}}, "pickle.loads(data)", "pickle.dumps(data)"),
    ("PY109", "Unmarshalling", "High", "CWE-502", "A08", {"node": "call", "match": {"callee": r"^marshal\.loads?$"}}, "marshal.loads(data)", "marshal.dumps(data)"),
    ("PY110", "Shelf of unknown origin", "Medium", "CWE-502", "A08", _call("shelve.open", kind={"arg0": OPEN_END}), "shelve.open(path)", "shelve.open('own.db')"),
    ("PY111", "YAML with any tags", "High", "CWE-502", "A08", _call("yaml.load", absent=["kw.Loader", "arg1"]), "yaml.load(text)", "yaml.load(text, Loader=yaml.SafeLoader)"),
    ("PY112", "YAML with an unsafe loader", "High", "CWE-502", "A08", _call("yaml.load", match={"kw.Loader": r"(^|\.)(UnsafeLoader|Loader|FullLoader)$"}), "yaml.load(text, Loader=yaml.Loader)", "yaml.load(text, Loader=yaml.SafeLoader)"),
    ("PY113", "MD5", "Medium", "CWE-327", "A02", _call("hashlib.md5"), "hashlib.md5(password)", "hashlib.sha256(password)"),
    ("PY114", "SHA-1", "Medium", "CWE-327", "A02", _call("hashlib.sha1"), "hashlib.sha1(password)", "hashlib.sha512(password)"),
    ("PY115", "Weak hash by name", "Medium", "CWE-327", "A02", _call("hashlib.new", match={"arg0": "(?i)^(md4|md5|sha1?)$"}), "hashlib.new('md5', data)", "hashlib.new('sha256', data)"),
    ("PY116", "Weak cipher", "High", "CWE-327", "A02", {"node": "call", "match": {"callee": r"(^|\.)(DES3?|ARC[24]|Blowfish)\.new$"}}, "DES.new(key)", "AES.new(key)"),
    ("PY117", "Cipher without chaining", "Medium", "CWE-327", "A02", {"node": "call", "match": {"callee": r"(^|\.)AES\.new$", "arg1": r"MODE_ECB$"}}, "AES.new(key, AES.MODE_ECB)", "AES.new(key, AES.MODE_GCM)"),
    ("PY118", "Predictable secret", "Medium", "CWE-338", "A02", {"node": "assign", "match": {"target": "(?i)token|secret|passw|nonce|salt", "value": r"^random\."}}, "token = random.randint(1, 9)", "token = secrets.token_hex()"),
    ("PY119", "Certificate not verified", "High", "CWE-295", "A02", {"node": "call", "match": {"callee": r"^(requests|httpx|session)\."}, "eq": {"kw.verify": "False"}}, "requests.get(url, verify=False)", "requests.get(url, verify=True)"),
    ("PY120", "Unverified TLS context", "High", "CWE-295", "A02", _call("ssl._create_unverified_context"), "ssl._create_unverified_context()", "ssl.create_default_context()"),
    ("PY121", "Host names not checked", "High", "CWE-295", "A02", {"node": "assign", "match": {"target": r"\.check_hostname$"}, "eq": {"value": "False"}}, "context.check_hostname = False", "context.check_hostname = True"),
    ("PY122", "SQL from parts", "Critical", "CWE-89", "A03", {"node": "call", "eq": {"attr": "execute"}, "kind": {"arg0": DYNAMIC}}, "cursor.execute(f'SELECT * FROM t WHERE id = {key}')", "cursor.execute('SELECT * FROM t WHERE id = %s', (key,))"),
    ("PY123", "SQL batch from parts", "Critical", "CWE-89", "A03", {"node": "call", "eq": {"attr": "executemany"}, "kind": {"arg0": DYNAMIC}}, "cursor.executemany('INSERT INTO ' + table, rows)", "cursor.executemany('INSERT INTO t VALUES (%s)', rows)"),
    ("PY124", "SQL script from parts", "Critical", "CWE-89", "A03", {"node": "call", "eq": {"attr": "executescript"}, "kind": {"arg0": DYNAMIC}}, "db.executescript('DROP TABLE %s' % name)", "db.executescript('DROP TABLE t')"),
    ("PY125", "SQL text from parts", "High", "CWE-89", "A03", {"node": "call", "match": {"callee": r"(^|\.)text$"}, "kind": {"arg0": DYNAMIC}}, "text('SELECT {}'.format(name))", "text('SELECT :name')"),
    ("PY126", "Raw query from parts", "High", "CWE-89", "A03", {"node": "call", "match": {"callee": r"\.(raw|extra)$"}, "kind": {"arg0": DYNAMIC}}, "User.objects.raw(f'SELECT {x}')", "User.objects.raw('SELECT 1')"),
    ("PY127", "File path from parts", "Medium", "CWE-22", "A01", _call("open", kind={"arg0": DYNAMIC}), "open('/data/' + name)", "open('/data/names')"),
    ("PY128", "File sent by a value", "High", "CWE-22", "A01", {"node": "call", "eq": {"attr": "send_file"}, "kind": {"arg0": OPEN_END}}, "send_file(request.args['f'])", "send_file('logo.png')"),
    ("PY129", "Archive extracted unchecked", "Medium", "CWE-22", "A01", {"node": "call", "eq": {"attr": "extractall"}, "absent": ["kw.filter", "kw.members"]}, "archive.extractall(path)", "archive.extractall(path, filter='data')"),
    ("PY130", "Request to a value", "Medium", "CWE-918", "A10", {"node": "call", "match": {"callee": r"^(requests|httpx)\.(get|post|put|delete|head|patch)$"}, "kind": {"arg0": DYNAMIC}}, "requests.get(f'http://{host}/')", "requests.get('http://own.example.com/')"),
    ("PY131", "URL opened by a value", "Medium", "CWE-918", "A10", {"node": "call", "eq": {"attr": "urlopen"}, "kind": {"arg0": OPEN_END}}, "urllib.request.urlopen(url)", "urllib.request.urlopen('https://own.example.com')"),
    ("PY132", "Redirect to a request value", "Medium", "CWE-601", "A01", {"node": "call", "eq": {"attr": "redirect"}, "match": {"arg0": r"\brequest\b"}}, "redirect(request.args['next'])", "redirect(url_for('home'))"),
    ("PY133", "Template from a value", "High", "CWE-79", "A03", {"node": "call", "eq": {"attr": "render_template_string"}, "kind": {"arg0": OPEN_END}}, "render_template_string(body)", "render_template_string('<p></p>')"),
    ("PY134", "Markup from a value", "Medium", "CWE-79", "A03", {"node": "call", "match": {"callee": r"(^|\.)(Markup|mark_safe)$"}, "kind": {"arg0": OPEN_END}}, "Markup(text)", "Markup('<b>x</b>')"),
    ("PY135", "Debug server", "Medium", "CWE-489", "A05", {"node": "call", "match": {"callee": r"\.run$"}, "eq": {"kw.debug": "True"}}, "app.run(debug=True)", "app.run(debug=False)"),
    ("PY136", "Server on all interfaces", "Low", "CWE-605", "A05", {"node": "call", "match": {"callee": r"\.run$"}, "eq": {"kw.host": "0.0.0.0"}}, "app.run(host='0.0.0.0')", "app.run(host='127.0.0.1')"),
    ("PY137", "Guessable temporary file", "Medium", "CWE-377", "A01", _call("tempfile.mktemp"), "tempfile.mktemp()", "tempfile.mkstemp()"),
    ("PY138", "File open to all", "Medium", "CWE-732", "A01", _call("os.chmod", eq={"arg1": "511"}), "os.chmod(path, 0o777)", "os.chmod(path, 0o600)"),
    ("PY139", "XML with entities", "High", "CWE-611", "A05", {"node": "call", "match": {"callee": r"XMLParser$"}, "eq": {"kw.resolve_entities": "True"}}, "etree.XMLParser(resolve_entities=True)", "etree.XMLParser(resolve_entities=False)"),
    ("PY140", "XML by the plain parser", "Medium", "CWE-611", "A05", {"node": "call", "match": {"callee": r"^(xml\.sax|xml\.dom\.minidom|minidom|sax)\.parse(String)?$"}}, "minidom.parseString(text)", "defusedxml.parseString(text)"),
    ("PY141", "Unencrypted login", "Medium", "CWE-319", "A02", {"node": "call", "match": {"callee": r"^(telnetlib\.Telnet|ftplib\.FTP)$"}}, "telnetlib.Telnet(host)", "ftplib.FTP_TLS(host)"),
    ("PY142", "Unknown host keys accepted", "High", "CWE-295", "A07", {"node": "call", "eq": {"attr": "set_missing_host_key_policy"}, "match": {"arg0": "AutoAddPolicy|WarningPolicy"}}, "client.set_missing_host_key_policy(paramiko.AutoAddPolicy())", "client.set_missing_host_key_policy(paramiko.RejectPolicy())"),
    ("PY143", "Token not verified", "Critical", "CWE-347", "A02", _call("jwt.decode", eq={"kw.verify": "False"}), "jwt.decode(token, key, verify=False)", "jwt.decode(token, key, algorithms=['HS256'])"),
    ("PY144", "Access checked by assert", "Medium", "CWE-617", "A01", {"node": "assert", "match": {"test": r"(?i)is_admin|is_staff|permission|authori[sz]ed"}}, "assert user.is_admin", "assert user.name"),
    ("PY145", "Errors swallowed", "Low", "CWE-390", "A09", {"node": "handler", "eq": {"body": "pass"}, "absent": ["type"]}, "try:\n    f()\nexcept:\n    pass", "try:\n    f()\nexcept ValueError:\n    pass"),
    ("PY146", "Hard-coded password", "High", "CWE-798", "A07", {"node": "assign", "match": {"target": r"(?i)(passw(or)?d|secret|api_?key|token)$", "value": ".{6,}"}, "kind": {"value": ["str"]}}, "db_password = 'hunter2hunter'", "db_password = os.environ['DB_PASSWORD']"),
    ("PY147", "Password in the log", "Medium", "CWE-532", "A09", {"node": "call", "match": {"callee": r"^(logging|logger|log)\.", "arg1": r"(?i)passw|secret|token"}}, "logger.info('login %s', password)", "logger.info('login %s', user)"),
    ("PY148", "Removed module", "Low", "CWE-1104", "A06", {"node": "import", "match": {"module": r"^(imp|telnetlib|crypt|cgi)$"}}, "import telnetlib", "import importlib"),
    ("PY149", "Cookie without protection", "Low", "CWE-614", "A05", {"node": "call", "eq": {"attr": "set_cookie", "kw.secure": "False"}}, "response.set_cookie('s', v, secure=False)", "response.set_cookie('s', v, secure=True)"),
    ("PY150", "Any origin allowed", "Medium", "CWE-942", "A05", {"node": "call", "match": {"callee": "(^|[.])CORS$"}, "eq": {"kw.origins": "*"}}, "CORS(app, origins='*')", "CORS(app, origins='https://own.example.com')"),
]


def _is(callee: str, kind: list[str] | None = None, at: str = "arg0", **conditions) -> dict:
    """A call whose callee fits a regular expression, and whose argument is of some kinds."""
    return {"node": "call", "match": {"callee": callee, **conditions.pop("match", {})}, **({"kind": {at: kind}} if kind else {}), **conditions}


_SECRET = {"node": "assign", "match": {"target": r"(?i)(passw(or)?d|secret|api_?key|token)$", "value": ".{6,}"}, "kind": {"value": ["str"]}}

#: The same for languages of brackets: language, and then as above.
BRACKET_RULES = [
    ("JavaScript", "JS101", "eval of a value", "Critical", "CWE-95", "A03", _call("eval", kind={"arg0": OPEN_END}), "eval(input);", "eval('1 + 1');"),
    ("JavaScript", "JS102", "Function from text", "High", "CWE-95", "A03", {"node": "call", "eq": {"callee": "Function"}, "match": {"new": "."}}, "const f = new Function(body);", "const f = make(body);"),
    ("JavaScript", "JS103", "Shell command", "Critical", "CWE-78", "A03", _is(r"(^|[.])(exec|execSync)$", DYNAMIC), "child_process.exec(`ls ${dir}`);", "child_process.exec('ls');"),
    ("JavaScript", "JS104", "Process through a shell", "High", "CWE-78", "A03", _is(r"(^|[.])(spawn|spawnSync|execFile)$", eq={"kw.shell": "true"}), "spawn(cmd, args, { shell: true });", "spawn(cmd, args, { shell: false });"),
    ("JavaScript", "JS105", "SQL from parts", "Critical", "CWE-89", "A03", _is(r"[.](query|execute|raw)$", DYNAMIC), "db.query('SELECT * FROM t WHERE id = ' + id);", "db.query('SELECT * FROM t WHERE id = ?', [id]);"),
    ("JavaScript", "JS106", "Markup from a value", "High", "CWE-79", "A03", {"node": "assign", "match": {"target": "[.](innerHTML|outerHTML)$"}, "kind": {"value": OPEN_END}}, "box.innerHTML = text;", "box.innerHTML = '';"),
    ("JavaScript", "JS107", "Text written to the page", "High", "CWE-79", "A03", _is(r"^document[.](write|writeln)$", OPEN_END), "document.write(text);", "document.write('<hr>');"),
    ("JavaScript", "JS108", "Certificate not verified", "High", "CWE-295", "A02", _is(".", eq={"kw.rejectUnauthorized": "false"}), "https.request(url, { rejectUnauthorized: false });", "https.request(url, { rejectUnauthorized: true });"),
    ("JavaScript", "JS109", "Weak hash", "Medium", "CWE-327", "A02", _is(r"(^|[.])createHash$", match={"arg0": "(?i)^(md4|md5|sha1)$"}), "crypto.createHash('md5');", "crypto.createHash('sha256');"),
    ("JavaScript", "JS110", "Predictable secret", "Medium", "CWE-338", "A02", {"node": "assign", "match": {"target": "(?i)token|secret|passw|nonce", "value": r"Math\.random"}}, "const token = Math.random();", "const token = crypto.randomUUID();"),
    ("JavaScript", "JS111", "Redirect to a request value", "Medium", "CWE-601", "A01", _is(r"[.]redirect$", match={"arg0": r"\breq(uest)?\."}), "res.redirect(req.query.next);", "res.redirect('/home');"),
    ("JavaScript", "JS112", "File path from a request", "High", "CWE-22", "A01", _is(r"(^|[.])(readFile|readFileSync|createReadStream|sendFile)$", match={"arg0": r"\breq(uest)?\."}), "fs.readFileSync('/data/' + req.params.name);", "fs.readFileSync('/data/names');"),
    ("JavaScript", "JS113", "Request to a request value", "High", "CWE-918", "A10", _is(r"^(fetch|got|axios([.](get|post))?)$", match={"arg0": r"\breq(uest)?\."}), "fetch(req.body.url);", "fetch('https://own.example.com');"),
    ("JavaScript", "JS114", "Token not verified", "High", "CWE-347", "A02", _call("jwt.decode"), "jwt.decode(token);", "jwt.verify(token, key);"),
    ("JavaScript", "JS115", "Any origin allowed", "Medium", "CWE-942", "A05", _call("cors", eq={"kw.origin": "*"}), "app.use(cors({ origin: '*' }));", "app.use(cors({ origin: own }));"),
    ("JavaScript", "JS116", "Hard-coded secret", "High", "CWE-798", "A07", _SECRET, "const apiKey = 'hunter2hunter';", "const apiKey = process.env.API_KEY;"),
    ("Go", "GO101", "Shell command", "Critical", "CWE-78", "A03", _call("exec.Command", eq={"arg1": "-c"}, kind={"arg2": OPEN_END}), 'exec.Command("sh", "-c", cmd)', 'exec.Command("sh", "-c", "date")'),
    ("Go", "GO102", "SQL from parts", "Critical", "CWE-89", "A03", _is(r"[.](Query|QueryRow|Exec)$", DYNAMIC), 'db.Query(fmt.Sprintf("SELECT %s", name))', 'db.Query("SELECT 1 WHERE id = ?", id)'),
    ("Go", "GO103", "SQL in a context from parts", "Critical", "CWE-89", "A03", _is(r"[.](Query|QueryRow|Exec)Context$", DYNAMIC, "arg1"), 'db.QueryContext(ctx, "SELECT " + name)', 'db.QueryContext(ctx, "SELECT 1")'),
    ("Go", "GO104", "Weak hash", "Medium", "CWE-327", "A02", _is(r"^(md5|sha1)[.](New|Sum)$"), "h := md5.New()", "h := sha256.New()"),
    ("Go", "GO105", "Certificate not verified", "High", "CWE-295", "A02", {"node": "literal", "eq": {"callee": "tls.Config", "kw.InsecureSkipVerify": "true"}}, "c := &tls.Config{InsecureSkipVerify: true}", "c := &tls.Config{InsecureSkipVerify: false}"),
    ("Go", "GO106", "Predictable random numbers", "Medium", "CWE-338", "A02", {"node": "import", "eq": {"module": "math/rand"}}, 'import "math/rand"', 'import "crypto/rand"'),
    ("Go", "GO107", "Markup from a value", "High", "CWE-79", "A03", _call("template.HTML", kind={"arg0": OPEN_END}), "x := template.HTML(body)", 'x := template.HTML("<hr>")'),
    ("Go", "GO108", "File path from a request", "High", "CWE-22", "A01", _is(r"^os[.](Open|ReadFile|Create)$", match={"arg0": r"\br\.|FormValue"}), 'os.Open(r.FormValue("name"))', 'os.Open("names")'),
    ("Go", "GO109", "Request to a value", "Medium", "CWE-918", "A10", _is(r"^http[.](Get|Post|Head)$", OPEN_END), "http.Get(url)", 'http.Get("https://own.example.com")'),
    ("Go", "GO110", "Hard-coded secret", "High", "CWE-798", "A07", _SECRET, 'password := "hunter2hunter"', 'password := os.Getenv("PASSWORD")'),
    ("Java", "JA101", "Process from a value", "Critical", "CWE-78", "A03", _is(r"getRuntime[(][)][.]exec$", OPEN_END), "Runtime.getRuntime().exec(cmd);", 'Runtime.getRuntime().exec("date");'),
    ("Java", "JA102", "SQL from parts", "Critical", "CWE-89", "A03", _is(r"[.](executeQuery|executeUpdate|prepareStatement|createQuery|createNativeQuery)$", DYNAMIC), 'st.executeQuery("SELECT * FROM t WHERE id = " + id);', 'st.executeQuery("SELECT 1");'),
    ("Java", "JA103", "Weak hash", "Medium", "CWE-327", "A02", _call("MessageDigest.getInstance", match={"arg0": "(?i)^(md5|sha-?1)$"}), 'MessageDigest.getInstance("MD5");', 'MessageDigest.getInstance("SHA-256");'),
    ("Java", "JA104", "Weak cipher", "High", "CWE-327", "A02", _call("Cipher.getInstance", match={"arg0": "^(DES|RC4|Blowfish)|/ECB/"}), 'Cipher.getInstance("AES/ECB/PKCS5Padding");', 'Cipher.getInstance("AES/GCM/NoPadding");'),
    ("Java", "JA105", "Objects from bytes", "High", "CWE-502", "A08", {"node": "call", "eq": {"callee": "ObjectInputStream"}, "match": {"new": "."}}, "var in = new ObjectInputStream(stream);", "var in = new DataInputStream(stream);"),
    ("Java", "JA106", "Predictable random numbers", "Medium", "CWE-338", "A02", {"node": "assign", "match": {"target": "(?i)token|secret|passw|nonce", "value": r"\bMath\.random|new Random\b"}}, "double token = Math.random();", "byte[] token = secureBytes();"),
    ("Java", "JA107", "File path from a request", "High", "CWE-22", "A01", {"node": "call", "eq": {"callee": "File"}, "match": {"new": ".", "arg0": "getParameter"}}, 'File f = new File(request.getParameter("f"));', 'File f = new File("names");'),
    ("Java", "JA108", "Redirect to a request value", "Medium", "CWE-601", "A01", _is(r"[.]sendRedirect$", match={"arg0": "getParameter"}), 'response.sendRedirect(request.getParameter("to"));', 'response.sendRedirect("/home");'),
    ("Java", "JA109", "XML with entities", "High", "CWE-611", "A05", _is(r"[.]setFeature$", match={"arg0": "external-general-entities"}, eq={"arg1": "true"}), 'f.setFeature("http://xml.org/sax/features/external-general-entities", true);', 'f.setFeature("http://xml.org/sax/features/external-general-entities", false);'),
    ("Java", "JA110", "Hard-coded secret", "High", "CWE-798", "A07", _SECRET, 'String password = "hunter2hunter";', 'String password = System.getenv("PASSWORD");'),
    ("Rust", "RS101", "Shell command", "Critical", "CWE-78", "A03", _is(r"Command[.]new[(][)]([.]\w+[(][)])*[.]arg$", OPEN_END), 'Command::new("sh").arg("-c").arg(cmd);', 'Command::new("sh").arg("-c");'),
    ("Rust", "RS102", "SQL from parts", "Critical", "CWE-89", "A03", _is(r"(^|[.])(sql_query|query|execute|query_as)$", DYNAMIC), 'sqlx::query(&format!("SELECT {}", name));', 'sqlx::query("SELECT 1");'),
    ("Rust", "RS103", "Bits taken as another type", "Medium", "CWE-843", "A04", _is(r"(^|[.])transmute$"), "let x = std::mem::transmute(y);", "let x = u32::from(y);"),
    ("Rust", "RS104", "Certificate not verified", "High", "CWE-295", "A02", _is(r"[.]danger_accept_invalid_(certs|hostnames)$", eq={"arg0": "true"}), "client.danger_accept_invalid_certs(true);", "client.danger_accept_invalid_certs(false);"),
    ("Rust", "RS105", "Weak hash", "Medium", "CWE-327", "A02", _is(r"(^|[.])(Md5|Sha1)[.](new|digest)$|^md5[.]compute$"), "let h = Md5::new();", "let h = Sha256::new();"),
    ("Rust", "RS106", "Text not checked", "Low", "CWE-20", "A04", _is(r"from_utf8_unchecked$"), "let s = String::from_utf8_unchecked(b);", "let s = String::from_utf8(b);"),
    ("Rust", "RS107", "File path from parts", "Medium", "CWE-22", "A01", _is(r"^(std[.])?(fs[.])?(File[.]open|fs[.]read_to_string|read_to_string)$", DYNAMIC), 'File::open(format!("/data/{}", name));', 'File::open("/data/names");'),
    ("Rust", "RS108", "Request to a value", "Medium", "CWE-918", "A10", _is(r"^reqwest[.](blocking[.])?get$", OPEN_END), "reqwest::get(url);", 'reqwest::get("https://own.example.com");'),
    ("Rust", "RS109", "Hard-coded secret", "High", "CWE-798", "A07", _SECRET, 'let password = "hunter2hunter";', 'let password = env::var("PASSWORD");'),
]
RULE_IDS = [r[0] for r in TREE_RULES] + [r[1] for r in BRACKET_RULES]


def test_cases(bad: str, good: str) -> list[tuple[str, bool]]:
    """Three cases that a rule must find and three that it must not, from one of each."""
    inside = lambda code: "def f():\n" + "".join(f"    {line}\n" for line in code.split("\n"))
    found = [bad, f"import sys\n{inside(bad)}", f"if ready:\n    x = 1\n{bad}\n"]
    clean = [good, inside(good), "text = " + repr(bad) + "\n# " + bad.replace("\n", "\n# ")]
    return [(code, True) for code in found] + [(code, False) for code in clean]


def bracket_cases(language: str, bad: str, good: str) -> list[tuple[str, bool]]:
    """The same in a language of brackets."""
    head = {"Go": "func f() {", "Rust": "fn f() {", "Java": "class A { void f(String x) throws E {"}.get(language, "function f(x) {")
    inside = lambda code: f"{head}\n    {code}\n{'}' * head.count('{')}\n"
    if bad.startswith("import "):
        inside = lambda code: f"package a\n{code}\nfunc f() {{}}\n"
    found = [bad, inside(bad), f"/* as it was */ {bad}\n"]
    clean = [good, inside(good), f"x = {json.dumps(bad)}\n// {bad}\n/* {bad}\n{bad} */"]
    return [(code, True) for code in found] + [(code, False) for code in clean]


def default_tree_rules(spark: SparkSession) -> DataFrame:
    """The rules of our own in the form of load_rules, with the pattern as tree."""
    from .files import RULE

    rows = [
        (i, name, severity, "Python", None, cwe, owasp, test_cases(bad, good), -1, k, json.dumps(pattern))
        for k, (i, name, severity, cwe, owasp, pattern, bad, good) in enumerate(TREE_RULES)
    ] + [
        (i, name, severity, x, None, cwe, owasp, bracket_cases(x, bad, good), -1, len(TREE_RULES) + k, json.dumps(pattern))
        for k, (x, i, name, severity, cwe, owasp, pattern, bad, good) in enumerate(BRACKET_RULES)
    ]
    return spark.createDataFrame(rows, f"{RULE}, tree string")
