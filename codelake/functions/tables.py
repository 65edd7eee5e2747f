"""Word tables. All of them are parameters of the operators that use them; these are the defaults.

Everything below is fixed values: the results depend on the words and, where a table is a
list, on their order.
"""

# File suffix to language of the scan; other files are not analysed.
SCANNED = [(".py", "python"), (".js", "javascript"), (".java", "java"), (".ts", "typescript"), (".tsx", "typescript")]
# Directories that a scan does not enter.
PRUNED = ["node_modules", "__pycache__", ".git", ".venv", "venv", "dist", "build", ".vscode", ".idea", ".pytest_cache"]
PRUNED_MORE = ["__pypackages__", ".tox", ".mypy_cache", "target", ".gradle", "out"]
# A file is left out if its lower-cased name contains one of these.
LEFT_OUT = [".spec.ts", ".spec.js", ".test.ts", ".test.js", ".spec.tsx", ".test.tsx", "test.ts", "test.js", "karma.conf.js", "jest.config.js", "webpack.config.js", "polyfills.ts", "polyfills.js", ".d.ts"]

CONFIG_FILES = [
    ("setup.py", "Python package configuration"),
    ("requirements.txt", "Python dependencies"),
    ("pyproject.toml", "Python project configuration"),
    ("Pipfile", "Pipenv dependencies"),
    ("poetry.lock", "Poetry lock file"),
    ("package.json", "Node.js dependencies"),
    ("config.yaml", "Application configuration"),
    ("config.yml", "Application configuration"),
    ("config.json", "Application configuration"),
    (".env", "Environment variables"),
    ("docker-compose.yml", "Docker Compose configuration"),
    ("Dockerfile", "Docker container configuration"),
    ("Makefile", "Build automation"),
    (".gitignore", "Git ignore rules"),
    ("README.md", "Project documentation"),
]
CONFIG_EXAMPLES = [("config.yaml", "yaml"), ("config.yml", "yaml"), ("config.json", "json"), (".env.example", "python"), ("settings.py", "python"), ("configuration.py", "python")]

MAIN_FILES = ["main.py", "app.py", "index.py", "run.py", "__main__.py"]
CLI_FILES = ["cli.py", "command.py", "console.py"]
API_WORDS = ["api", "server"]
MAIN_GUARDS = ['if __name__ == "__main__"', "if __name__ == '__main__'"]

# Directory word (first match wins) and purpose.
PURPOSES = [
    ("src", "Source code - main application code"),
    ("tests", "Unit tests and test suites"),
    ("test", "Unit tests and test suites"),
    ("docs", "Documentation files"),
    ("documentation", "Documentation files"),
    ("config", "Configuration files"),
    ("utils", "Utility functions and helpers"),
    ("helpers", "Helper functions and utilities"),
    ("models", "Data models and schemas"),
    ("views", "View layer / UI components"),
    ("controllers", "Controller layer / request handlers"),
    ("services", "Business logic services"),
    ("api", "API endpoints and routes"),
    ("database", "Database schemas and migrations"),
    ("db", "Database related code"),
    ("migrations", "Database migration scripts"),
    ("middleware", "Middleware components"),
    ("routes", "Application routes"),
    ("schemas", "Data schemas and validation"),
    ("components", "Reusable components"),
    ("lib", "Library code"),
    ("core", "Core application functionality"),
    ("common", "Common/shared code"),
    ("shared", "Shared resources and code"),
    ("assets", "Static assets"),
    ("static", "Static files (CSS, JS, images)"),
    ("public", "Publicly accessible files"),
    ("build", "Build artifacts"),
    ("dist", "Distribution files"),
    ("scripts", "Utility scripts"),
    ("tools", "Development tools"),
    ("examples", "Example code and demos"),
    ("analyzers", "Code analyzers"),
    ("providers", "Service providers"),
    ("generators", "Code generators"),
]

# Pattern, confidence, description; the first of equal confidence wins.
ARCHITECTURES = [
    ("MVC", 0.8, "Model-View-Controller pattern with clear separation of concerns"),
    ("Layered", 0.7, "Layered architecture with distinct layers (presentation, business, data)"),
    ("Clean Architecture", 0.8, "Clean architecture with dependency inversion and domain-centric design"),
    ("Microservices", 0.7, "Microservices architecture with multiple independent services"),
    ("Modular Monolith", 0.7, "Modular monolithic structure with well-defined module boundaries"),
    ("Simple/Flat", 0.9, "Simple flat structure suitable for small projects"),
]
NO_ARCHITECTURE = ("Custom", "Custom architecture tailored to specific requirements")
MVC_DIRS = ["models", "views", "controllers"]
LAYER_DIRS = ["services", "repositories", "controllers", "models"]
CLEAN_DIRS = ["domain", "application", "infrastructure", "presentation"]
MODULE_DIRS = ["modules", "components"]

FEATURES = [
    ("API", ["api", "endpoint", "route", "request", "response"]),
    ("Database", ["database", "db", "model", "query", "migration", "schema"]),
    ("Authentication", ["auth", "login", "token", "jwt", "password", "user"]),
    ("Caching", ["cache", "redis", "memcache"]),
    ("Logging", ["log", "logger", "logging"]),
    ("Testing", ["test", "mock", "fixture"]),
    ("CLI", ["cli", "command", "console", "argparse"]),
    ("File Processing", ["file", "read", "write", "parse", "upload"]),
    ("Data Analysis", ["analyze", "process", "transform", "aggregate"]),
    ("Web Scraping", ["scrape", "crawl", "spider", "requests"]),
    ("Machine Learning", ["model", "train", "predict", "ml", "ai"]),
    ("Documentation", ["doc", "generate", "markdown", "readme"]),
]
FRAMEWORKS = ["flask", "django", "fastapi", "express", "react", "vue", "angular", "pandas", "numpy", "tensorflow", "pytorch"]
TEST_FRAMEWORKS = ["unittest", "pytest", "nose", "jest", "mocha"]
LANGUAGE_SUFFIXES = [(".py", "Python"), (".js", "JavaScript"), (".jsx", "JavaScript"), (".ts", "TypeScript"), (".tsx", "TypeScript"), (".java", "Java")]
# Languages of a diagram; TypeScript counts as JavaScript there.
DIAGRAM_LANGUAGES = [(".py", "Python"), (".js", "JavaScript"), (".jsx", "JavaScript"), (".ts", "JavaScript"), (".tsx", "JavaScript"), (".java", "Java"), (".go", "Go"), (".rs", "Rust"), (".rb", "Ruby"), (".php", "PHP"), (".cs", "C#"), (".cpp", "C++"), (".cc", "C++"), (".c", "C++")]

STDLIB = """os sys json logging pathlib typing collections itertools functools re datetime time math random
ast io pickle csv unittest argparse configparser subprocess threading multiprocessing asyncio concurrent
copy enum abc dataclasses warnings traceback inspect
string operator types weakref heapq bisect array struct codecs textwrap unicodedata stringprep difflib
hashlib hmac secrets uuid html xml email mimetypes base64 binascii quopri uu bz2 gzip lzma zipfile
tarfile sqlite3 dbm marshal shelve zlib http urllib socket ssl select selectors signal
mmap ctypes platform errno locale gettext decimal fractions numbers cmath statistics pprint reprlib
contextvars contextlib importlib pkgutil modulefinder runpy parser symbol token keyword tokenize tabnanny
pyclbr py_compile compileall dis pickletools zipapp venv ensurepip typing_extensions""".split()

SOURCE_WORDS = ["input", "read", "fetch", "request", "get", "load", "parse", "receive", "query", "select"]
SINK_WORDS = ["output", "write", "send", "post", "put", "save", "store", "insert", "update", "delete", "print", "log"]
ERROR_WORDS = ["try", "catch", "except", "finally", "error", "throw", "raise"]
ASYNC_WORDS = ["async", "await", "promise", "future", "callback", "then"]
OBSERVER_WORDS = ["subscribe", "notify", "observer", "listen", "emit", "event"]
FACTORY_PREFIXES = ["create", "make", "build"]
DECORATOR_WORDS = ["decorator", "wrapper"]
DATABASE_WORDS = ["sql", "mongo", "redis", "database"]

EXAMPLE_WORDS = ["example", "demo", "sample"]
API_PATH_WORDS = ["api", "route", "endpoint", "handler"]
API_DECORATOR_WORDS = ["route", "get", "post", "put", "delete", "api"]
CLI_IMPORT_WORDS = ["argparse", "click", "typer", "fire"]
CLI_FUNCTION_WORDS = ["parse", "cli", "command", "main"]

# Rank of a file: points if the lower-cased path contains one of the words.
RANK_WORDS = [(-100, ["test"]), (50, ["main"]), (30, ["api", "route", "endpoint"]), (-5, ["util", "helper"])]
RANK_PER_CLASS, RANK_PER_FUNCTION = 10, 5

VAGUE_WORDS = ["handles", "processes", "manages", "deals with", "works with", "does stuff"]
SECTIONS = ["summary", "params", "returns", "examples", "performance", "error_handling", "throws", "notes"]

DROPPED_LINES = ["yourusername/your-repo", "yourusername", "your-repo", "Project title with relevant badges", "One-line compelling description", "Include real code examples for", "List specific problems developers encounter", "[Sequence Diagram]", "[Placeholder]"]
PLACEHOLDERS = ["yourusername", "your-repo", "your-project"]
SPLIT_DIRS = ["src", "app", "lib", "controllers", "models", "views", "services", "routes"]
SPLIT_FILES = ["index", "main", "app", "server", "routes", "models"]
