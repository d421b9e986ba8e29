"""Fixed values of the data model: names, lists and lookup tables that results depend on."""

# Directories never entered.
EXCLUDED_DIRS = (
    "node_modules", ".git", "__pycache__", ".mypy_cache", ".pytest_cache", "build", "dist", "out", "target", ".gradle", ".idea", ".vscode",
    "vendor", "third_party", "venv", ".venv", "env", ".env", "coverage", ".nyc_output", "htmlcov",
)
# Extensions of source files.
SOURCE_EXTENSIONS = (
    ".py", ".pyi", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".java", ".kt", ".scala", ".groovy", ".c", ".cpp", ".cc", ".cxx", ".h", ".hpp", ".rs", ".go",
    ".html", ".css", ".scss", ".vue", ".svelte", ".toml", ".yaml", ".yml", ".json", ".rb", ".php", ".cs", ".swift", ".sh", ".bash", ".zsh",
)
MAX_FILE_BYTES = 2 * 1024 * 1024
SNIFFED_BYTES = 8192
# Extension -> language.
EXTENSION_LANGUAGE = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".kt": "kotlin", ".kts": "kotlin", ".scala": "scala", ".go": "go", ".rs": "rust", ".c": "c", ".h": "c", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".hpp": "cpp",
    ".cs": "csharp", ".rb": "ruby", ".php": "php", ".swift": "swift", ".vue": "vue", ".svelte": "svelte", ".html": "html", ".htm": "html", ".css": "css", ".scss": "scss",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell", ".toml": "toml", ".yaml": "yaml", ".yml": "yaml", ".json": "json", ".groovy": "groovy",
}
# Interpreter prefix -> language, the first that fits counts.
SHEBANG_LANGUAGE = {
    "python": "python", "python3": "python", "node": "javascript", "ruby": "ruby", "bash": "shell", "sh": "shell", "zsh": "shell", "perl": "perl", "php": "php",
}
# File name -> language.
FILENAME_LANGUAGE = {
    "Makefile": "makefile", "makefile": "makefile", "GNUmakefile": "makefile", "Dockerfile": "dockerfile", "Jenkinsfile": "groovy", "Vagrantfile": "ruby", "Rakefile": "ruby",
    "Gemfile": "ruby", "Podfile": "ruby", ".bashrc": "shell", ".zshrc": "shell", ".profile": "shell",
}
# Languages that are listed but not parsed.
UNPARSED_LANGUAGES = ("json", "yaml", "toml", "html", "css", "scss", "markdown", "text", "unknown")
# Callees that are left out of call edges, per language; compared in lower case but for JavaScript.
PYTHON_NOISE = tuple(
    """print len range str int float bool list dict set tuple type super isinstance issubclass hasattr getattr setattr delattr callable map filter zip enumerate sorted reversed
    any all sum min max abs round pow open input format repr id hash iter next vars dir help object property staticmethod classmethod
    append extend insert remove pop clear copy update keys values items get setdefault add discard union intersection difference
    strip split join replace find count startswith endswith upper lower title encode decode format_map read write readline readlines close seek tell
    connect cursor execute fetchall fetchone commit rollback logging logger warning error debug info critical
    assertequal asserttrue assertfalse assertraises assertin assertnotin assertisnone assertisnotnone""".split()
)
JAVASCRIPT_NOISE = tuple(
    """push pop shift unshift splice slice map filter reduce forEach find findIndex some every includes indexOf join split replace trim toLowerCase toUpperCase
    toString valueOf hasOwnProperty keys values entries assign freeze create then catch finally resolve reject json text blob arrayBuffer formData clone
    addEventListener removeEventListener dispatchEvent setAttribute getAttribute removeAttribute appendChild querySelector querySelectorAll getElementById getElementsByClassName
    preventDefault stopPropagation toFixed toLocaleString toLocaleDateString delete get set has clear size start end test exec match search
    round floor ceil abs max min random sqrt pow now parse stringify send status redirect emit on off once removeListener
    setTimeout setInterval clearTimeout clearInterval requestAnimationFrame cancelAnimationFrame scrollTo scrollIntoView focus blur click
    fromEntries flat flatMap fill copyWithin sort reverse concat""".split()
)
GO_NOISE = tuple(
    "println print printf sprintf fprintf errorf scanf len cap append copy delete make new close panic recover string int int64 int32 float64 bool byte rune error errors".split()
)
# Names that are no references.
PYTHON_NO_REFERENCE = tuple("True False None self cls int str float bool list dict set tuple type object super".split())
JAVASCRIPT_NO_REFERENCE = tuple(
    """true false null undefined this super arguments void typeof instanceof new return if else for while do switch case break continue throw try catch finally
    const let var function class import export default from of in async await yield static extends implements interface type enum namespace module declare""".split()
)
# Bases that make a Python class an enum or an interface.
PYTHON_ENUM_BASES = ("enum", "intenum", "strenum", "flag", "intflag")
PYTHON_INTERFACE_BASES = ("protocol",)
# Kinds of nodes in groups.
FUNCTION_KINDS = ("function", "method", "constructor", "lambda")
CLASS_KINDS = ("class", "interface", "struct", "enum")
IMPORT_KINDS = ("import", "require", "include")
# Colours of kinds in drawings.
KIND_COLOURS = {"module": "#FFD166", "class": "#EF476F", "function": "#06D6A0", "method": "#118AB2", "import": "#8D99AE"}
OTHER_COLOUR = "#CCCCCC"
# Types of graph edges, the weakest first; of several between two nodes the strongest holds.
EDGE_TYPES = ("calls", "imports", "inherits", "defines")
