"""Problem 5: generated, minified or vendored files and data blobs, by belief propagation over the directory tree.

Every file and every directory is a variable over five labels. A file's own text and name give its evidence, a
directory's name a prior, and each parent-child edge a compatibility: vendored files come in whole directories,
generated ones often, minified files and blobs seldom. On a tree the two sweeps (leaves to root, root to leaves)
are exact; each is one aggregation and one join a level. Messages are computed in numpy over whole batches.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.common import stage_of
from quarry.llm.sourcecheck import LANGUAGES, parse_status

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
#: How likely a child has its parent's label; the rest goes to the others, most of it to handwritten.
KEEPS = {"handwritten": 0.97, "generated": 0.55, "minified": 0.3, "vendored": 0.98, "blob": 0.3}
#: P(subdirectory's label | directory's) for handwritten directories, which often hold one of another kind.
VENDORED_WHOLE = 0.995
SUBDIRECTORIES = (0.82, 0.06, 0.02, 0.08, 0.02)

# Directory names under which other projects' files are kept, and those for output of tools.
VENDOR_DIRS = "third_party|thirdparty|third-party|3rdparty|3rd_party|node_modules|vendor|vendored|extern|external|externals|bundled|deps|bower_components|site-packages|jspm_packages"
SHARED_DIRS = "contrib|lib_ext|libs_ext"
OUTPUT_DIRS = "gen|generated|_generated|autogen|__generated__"
# Wordings that say a tool wrote the file, inside a comment.
TOOL_SAYS = re.compile(
    r"@generated\b|<auto-?generated|\bauto-?\s?generated\b|\bautogenerated\b|\bgenerated (code|file|source)\b(?! (generator|by hand))|\bcode (was )?generated\b|\b(file|class|module|code|source|header|client|stub|bindings?) (is|was|has been) (machine[- ](made|generated)|(automatically )?(generated|created|produced|emitted|written) (by|from|with|using) [\w./-]*(gen|idl|proto|tool|compiler|script|schema|generator|protoc|antlr|swagger|openapi)\w*)"
    r"|\bmachine[- ](made|generated)\b|\bgenerated (from|by|with|using) \S*(\.(idl|proto|thrift|g4|y|xsd|wsdl|graphql|yaml|json|avsc)\b|gen\b|protoc|antlr|swagger|openapi|generator|\d+\.\d+)"
    r"|\b(produced|created|emitted|compiled|transpiled|built|written) by \w*(gen|compiler|tsc|babel|protoc|webpack|rollup|esbuild|bison|flex|cython|coffee\w*)\b|\bproduced by \w+ v?\d+\.\d+"
    r"|\bdo not (edit|modify|change|touch)( this file)?( manually| by hand| directly)?\s*([.!:;,(]|$)|\bdon't (edit|modify)( this file)?( by hand| manually)?\s*([.!]|$)|\bedits? (will|would|are going to) be (lost|overwritten)|\bchanges will be (lost|overwritten)"
    r"|\b(re)?(generate|build) (it )?with (`|--|make\b|the command)|\bedit (that|the (schema|idl|template|source|spec)) instead\b|^\W*source: \S+\.(idl|proto|thrift|g4|graphql|xsd)\b"
    r"|généré(e)? automatiquement|ne pas (modifier|éditer)\b|automatisch (erzeugt|generiert|erstellt)|nicht (von hand |manuell )(ändern|bearbeiten|editieren)|generado automáticamente|no (modificar|editar)\b|sourceMappingURL=",
    re.I,
)
COMPILED = re.compile(r"Object\.defineProperty\(exports, ?[\"']__esModule[\"']|__webpack_require__|_interopRequireDefault|\b__extends\b = |__awaiter = ")
TOOL_NAMES = re.compile(r"\.(pb|gen|g|generated|designer)\.\w+$|_pb2(_grpc)?\.py$|\.pb\.\w+$|_generated\.\w+$|(^|/)\w*_gen\.go$", re.I)
WEAK_TOOL_NAMES = re.compile(r"(Proto|OuterClass|Grpc|Stub)(V\w*)?\.java$")
# Wordings that say the file is another project's.
COPIED_SAYS = re.compile(
    r"\b(verbatim|unmodified|vendored|local|bundled) copy of \S+|\bupstream archive\b|\bvendored (from|by|at)\b|\bcopied (verbatim )?from \S+ (v?\d|project|upstream|\()|\btaken from upstream\b|\bimported from upstream\b"
    r"|\b(released|licensed|distributed|available) under the .*\b(licen[cs]e|mit|bsd|apache)\b|\bfree for any use\b|^[/*#\s!]*[\w.-]+(\.js)? v\d+\.\d+(\.\d+)?\s*($|[|(])|\ball rights reserved\b",
    re.I,
)
_OWNER = re.compile(r"copyright (?:\(c\)|©)?\s*(?:\d{4}[-, \d]*)?\s*(?:the |by )?([\w-]+)|licensed to the ([\w-]+)|^[/*#\s!]*([\w.-]+) v?\d+\.\d+\.\d+\b|copy of ([\w.-]+)", re.I)
_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`")
_NUMBERS = re.compile(r"(?:(?:0[xX][0-9a-fA-F]+|-?\d+(?:\.\d+)?)[uUlLiIfF\d]*\s*,\s*){12,}")
_LONG_STRING = re.compile(r"[\"'`]((?:[A-Za-z0-9+/=_\-]|\\x[0-9a-fA-F]{2}|\\[\\n]){400,})[\"'`]|(?:[\"'][A-Za-z0-9+/=\\x]{40,}[\"'][\s,+\\.)(]*){8,}")
# Beginnings of lines that may stand before a file's first comment or between its first ones.
_PREAMBLE = re.compile(r"#!|package\b|import\b|from\b|use\b|using\b|module\b|namespace\b|#\[|#!\[|[\"']use strict|<\?|@charset|%|---|[{}()\[\]]|Object\.defineProperty\(exports|extern crate|var __|\\")
_COMMENT = re.compile(r"^\s*(?://|/\*|\*|#(?!!)|--|<!--|;;|\"\"\"|''')")


def comment_blocks(text: str) -> tuple[list[str], list[str]]:
    """The comments before the first statement, however long they are, and those after the last one.

    Package and import lines, attributes and mode strings may stand before and between the first; a licence of a
    hundred lines and what follows it are read whole.
    """
    first: list[str] = []
    doc = block = False
    lines = text.split("\n")
    for x in lines:
        s = x.strip()
        if not s:
            continue
        fences = s.count('"""') + s.count("'''")
        if doc or block or _COMMENT.match(x) or s.startswith("/*"):
            first.append(s)
        elif not _PREAMBLE.match(s):
            break
        doc = doc != (fences % 2 == 1)
        block = (block or s.startswith("/*")) and "*/" not in s
    last: list[str] = []
    for x in reversed(lines):
        s = x.strip()
        if s and not _COMMENT.match(x):
            break
        if s:
            last.append(s)
    return first, last


def evidence(project: str, path: str, text: str) -> list[float]:
    """Log-likelihoods of the five labels from one file's text and name; handwritten's is 0."""
    out = [0.0, -2.0, -3.0, -0.7, -3.0]
    ext = path.rsplit(".", 1)[-1].lower()
    code = ext in ("py", "rs", "js", "ts", "go", "java", "c", "h", "cpp", "jsx", "tsx", "css", "mjs", "cjs")
    if ext == "md":
        return [0.0, -9.0, -9.0, -0.7, -9.0]
    comments, closing = comment_blocks(text)
    if any(TOOL_SAYS.search(x) for x in comments + closing):
        out[1] += 9
    if code and COMPILED.search(text):
        out[1] += 9
    if TOOL_NAMES.search(path):
        out[1] += 8.5
    elif WEAK_TOOL_NAMES.search(path):
        out[1] += 7.5
    owners = {y.lower() for x in comments for m in [_OWNER.search(x)] if m for y in m.groups() if y}
    own = {project.lower(), *project.lower().split("-")}
    foreign = {o for o in owners if o not in own and o.replace("_", "-") not in own}
    if any(COPIED_SAYS.search(x) for x in comments) and (foreign or not owners):
        out[3] += 8 if foreign else 5
    elif foreign and any("copyright" in x.lower() for x in comments):
        out[3] += 5
    bare = _STRING.sub('""', text)
    size = max(1, len(bare))
    wide = sum(len(x) for x in bare.split("\n") if len(x) > 160) / size
    space = sum(bare.count(c) for c in " \t\n") / size
    if code and size > 300 and wide > 0.6 and space < 0.1:
        out[2] += 11
        if out[3] > 0:
            out[3] -= 5
    if code and len(text) > 600:
        held = sum(len(m.group()) for m in _NUMBERS.finditer(text)) + sum(len(m.group()) for m in _LONG_STRING.finditer(text))
        if held > 0.7 * len(text):
            out[4] += 11
    return out


def directory_prior(name: str, depth: int) -> list[float]:
    """Log-prior of a directory's label from its name; handwritten's is 0. Depth 1 is the project itself."""
    out = [0.0, -0.5, -0.5, -1.5, -0.5]
    if depth == 1:
        return [0.0, -6.0, -6.0, -6.0, -6.0]
    if re.fullmatch(VENDOR_DIRS, name, re.I):
        out[3] += 9
    elif re.fullmatch(SHARED_DIRS, name, re.I):
        out[3] += 3.5
    elif re.fullmatch(OUTPUT_DIRS, name, re.I):
        out[1] += 4
    if re.fullmatch(r"[a-z][\w.]*-v?\d+\.\d+(\.\d+)?", name, re.I):
        out[3] += 5
    return out


def _files(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = []
        for project, path, text in zip(f.project, f.relative_path, f.content):
            text, path = text or "", path.replace("\\", "/")
            language = LANGUAGES.get(path.rsplit(".", 1)[-1].lower())
            rows.append((path, path.rsplit("/", 1)[0] if "/" in path else "", language is None or parse_status(language, text)[0] == "ok", *evidence(project or path.split("/")[0], path, text)))
        out = pd.DataFrame(rows, columns=["path", "dir", "parses", *_cols("b")])
        yield out.assign(**dict(zip(_cols("u"), message(out[_B].to_numpy(dtype=float), True).T)))


def _cols(p: str) -> list[str]:
    return [f"{p}{i}" for i in range(len(LABELS))]


def _log_compatibility(directories: bool) -> list[list[float]]:
    """log P(child label | parent label) of files, or of directories, in a directory."""
    rows = []
    for a, x in enumerate(LABELS):
        if directories and a == 0:
            rows.append([math.log(v) for v in SUBDIRECTORIES])
            continue
        keeps = VENDORED_WHOLE if directories and x == "vendored" else KEEPS[x]
        rest = 1 - keeps
        others = [b for b in range(len(LABELS)) if b != a]
        share = [0.8 if b == 0 else 0.2 / (len(others) - 1) for b in others] if a else [1 / len(others)] * len(others)
        rows.append([math.log(keeps) if b == a else math.log(rest * share[others.index(b)]) for b in range(len(LABELS))])
    return rows


PSI = {False: _log_compatibility(False), True: _log_compatibility(True)}


def message(belief: np.ndarray, upward: bool, directories: bool = False) -> np.ndarray:
    """Sum-product messages over edges, a row each, normalised to handwritten: to the parent if upward, else to the child."""
    psi = np.exp(np.array(PSI[directories]))
    top = belief.max(axis=1, keepdims=True)
    sums = np.log(np.exp(belief - top) @ (psi.T if upward else psi))
    return sums - sums[:, :1]


_B = _cols("b")
_MESSAGES = ", ".join(f"{c} double" for c in _cols("u"))


def _upward(df: DataFrame, names: list[str], directories: bool) -> DataFrame:
    """df(names, b0..) -> (names, b0.., u0..): beliefs with the message each sends to its parent."""

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(**dict(zip(_cols("u"), message(f[_B].to_numpy(), True, directories).T)))

    schema = ", ".join([*(f"{c} string" for c in names), *(f"{c} double" for c in _B), _MESSAGES])
    return df.select(*names, *_B).mapInPandas(told, schema)


def _sums(messages: DataFrame, key: str) -> DataFrame:
    """The messages of all children of each directory, summed before the shuffle."""
    return messages.groupBy(F.col(key).alias("dir")).agg(*(F.sum(c).alias(c) for c in _cols("u")))


def _added(df: DataFrame, sums: DataFrame, names: list[str]) -> DataFrame:
    return df.join(sums, "dir", "left").select(*names, *((F.col(b) + F.coalesce(u, F.lit(0.0))).alias(b) for b, u in zip(_B, _cols("u"))))


def labels(source_files: DataFrame) -> DataFrame:
    """source_files(project, relative_path, content, ...) -> (relative_path, label, odds, parses).

    label is the likeliest of LABELS, odds its log-odds to handwritten. Directories are aggregated before the
    shuffle, so one that holds a third of the files is no hot group; a null content counts as empty (handwritten);
    null paths are kept out; repeated paths are judged each for itself and strengthen their directory.
    """
    stage = stage_of(source_files, "tree")
    files = source_files.where("relative_path is not null").select("project", "relative_path", "content")
    schema = "path string, dir string, parses boolean, " + ", ".join(f"{c} double" for c in [*_B, *_cols("u")])
    files = stage.write(files.mapInPandas(_files, schema), "files")
    from_files = stage.write(_sums(files, "dir"), "leaves")
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat_ws("/", F.slice(parts, F.lit(1), i)))
    dirs = from_files.select(F.explode(above).alias("dir")).distinct()

    def prior(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            depth = f.dir.str.count("/") + 1
            priors = np.array([directory_prior(d.rsplit("/", 1)[-1], n) for d, n in zip(f.dir, depth)]).reshape(-1, len(LABELS))
            yield pd.DataFrame({"dir": f.dir, "depth": depth.astype("int32"), "up_dir": [d.rsplit("/", 1)[0] if "/" in d else None for d in f.dir], **dict(zip(_B, priors.T))})

    dirs = dirs.mapInPandas(prior, "dir string, depth int, up_dir string, " + ", ".join(f"{c} double" for c in _B))
    dirs = stage.write(_added(dirs, from_files, ["dir", "depth", "up_dir"]), "dirs")
    stage.drop(from_files)
    deepest = dirs.agg(F.max("depth")).first()[0] or 0
    levels: dict[int, DataFrame] = {}
    for depth in range(deepest, 0, -1):
        here = dirs.where(F.col("depth") == depth).drop("depth")
        if depth < deepest:
            here = _added(here, _sums(levels[depth + 1], "up_dir"), ["dir", "up_dir"])
        levels[depth] = stage.write(_upward(here, ["dir", "up_dir"], True), f"up{depth}")
    stage.drop(dirs)
    done: list[DataFrame] = []
    for depth in range(1, deepest + 1):
        here = levels[depth]
        if done:
            # what the parent believes without what this directory told it
            parent = done[-1].select(F.col("dir").alias("up_dir"), *(F.col(c).alias(p) for c, p in zip(_B, _cols("p"))))
            here = here.join(parent, "up_dir").mapInPandas(_told(True), "dir string, " + ", ".join(f"{c} double" for c in _B))
        done.append(stage.write(here.select("dir", *_B), f"down{depth}"))
    stage.drop(*levels.values())
    if not done:
        return files.select(F.col("path").alias("relative_path"), F.lit("").alias("label"), F.lit(0.0).alias("odds"), "parses")
    beliefs = reduce(DataFrame.unionByName, done).select("dir", *(F.col(c).alias(p) for c, p in zip(_B, _cols("p"))))
    return files.join(beliefs, "dir", "left").mapInPandas(_judged, "relative_path string, label string, odds double, parses boolean")


def _down(f: pd.DataFrame, directories: bool) -> np.ndarray:
    """Beliefs of children (b0.., and u0.. what they told) that hear from their parents (p0..; none for null)."""
    rest = f[_cols("p")].to_numpy() - f[_cols("u")].to_numpy()
    heard = message(np.nan_to_num(rest), False, directories)
    heard[np.isnan(rest).any(axis=1)] = 0.0
    return f[_B].to_numpy() + heard


def _told(directories: bool):
    def heard(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"dir": f.dir, **dict(zip(_B, _down(f, directories).T))})

    return heard


def _judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        belief = _down(f, False)
        # ties: the label that comes last in the alphabet
        order = sorted(range(len(LABELS)), key=lambda k: LABELS[k], reverse=True)
        best = np.array(order)[belief[:, order].argmax(axis=1)] if len(f) else np.zeros(0, dtype=int)
        yield pd.DataFrame({"relative_path": f.path, "label": np.array(LABELS)[best], "odds": belief.max(axis=1) - belief[:, 0] if len(f) else [], "parses": f.parses})


def not_handwritten(source_files: DataFrame) -> DataFrame:
    """The paths of files made by a tool, minified, copied in or mere data, once each; files that do not parse are none."""
    return labels(source_files).where("label <> 'handwritten' and parses").select("relative_path").distinct()


def label_counts(source_files: DataFrame) -> DataFrame:
    """Files by label, of those that parse: (label, files)."""
    return labels(source_files).where("parses").groupBy("label").agg(F.count("*").alias("files"))
