"""Fixed values. These lists define the measure; results are only comparable
with other runs of the same measure if they stay exactly as they are."""

# --- Fixed values: file types -------------------------------------------------

FILE_TYPES = (
    "test_code", "main_code", "test_resources", "main_resources",
    "scripts", "documentation", "build", "other",
)

# --- Fixed values: extension -> language --------------------------------------

LANGUAGE_BY_EXTENSION = {
    ".java": "java", ".kt": "kotlin", ".scala": "scala", ".groovy": "groovy",
    ".py": "python", ".rb": "ruby",
    ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript",
    ".ts": "typescript", ".tsx": "typescript",
    ".go": "go", ".rs": "rust",
    ".xml": "xml", ".properties": "properties",
    ".yaml": "yaml", ".yml": "yaml", ".json": "json",
    ".sh": "shell", ".bash": "shell", ".zsh": "shell",
    ".md": "markdown", ".txt": "text", ".rst": "text", ".adoc": "text",
    ".html": "html", ".scss": "scss", ".css": "css", ".j2": "jinja2",
    ".gradle": "gradle", ".kts": "kotlin", ".sbt": "sbt",
    ".toml": "toml", ".cfg": "ini", ".ini": "ini",
    ".container": "quadlet", ".pod": "quadlet", ".volume": "quadlet",
    ".network": "quadlet", ".kube": "quadlet", ".build": "quadlet", ".image": "quadlet",
}

SCRIPT_EXTENSIONS = (".sh", ".bash", ".zsh")
DOCUMENTATION_EXTENSIONS = (".md", ".txt", ".rst", ".adoc")

# --- Fixed values: code files without a known extension -----------------------

CODE_BASENAMES = (".ansible-lint",)
CODE_BASE_PREFIXES = ("dockerfile", "docker-compose", "podman-compose")
CODE_BASE_SUFFIXES = (".dockerfile",)

# --- Fixed values: build files ------------------------------------------------

QUADLET_EXTENSIONS = (
    ".container", ".pod", ".volume", ".network", ".kube", ".build", ".image",
)
BUILD_EXTENSIONS = (".gradle", ".kts", ".sbt", ".toml", ".cfg", ".ini")
BUILD_BASENAMES = (
    "pom.xml", "setup.py", "package.json", "package-lock.json", "angular.json",
    "requirements.txt", "requirements.yml", ".ansible-lint",
    ".pre-commit-config.yaml", ".gitlab-ci.yml",
)
COMPOSE_BASENAMES = (
    "compose.yml", "compose.yaml", "compose.override.yml", "compose.override.yaml",
)

# --- Fixed values: test and resource paths ------------------------------------

TEST_SEGMENTS = ("test", "tests", "__tests__", "spec", "specs", "e2e", "cypress", "molecule")
RESOURCE_SEGMENTS = ("resources", "resource", "assets", "static", "public", "templates")
SCRIPT_TEST_EXTENSIONS = (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")
JVM_TEST_EXTENSIONS = (".java", ".kt", ".scala")

# --- Fixed values: directories left out of an inventory -----------------------

SKIPPED_DIRECTORIES = (
    "target", ".git", ".mvn", "node_modules", "dist", "build", ".idea", ".vscode",
    "__pycache__", ".pytest_cache", "venv", ".venv", ".gradle", "ansible_collections",
    ".next", ".nuxt", ".angular", ".turbo", ".nx", "test-results",
)
SKIPPED_DIRECTORY_SUFFIX = ".egg-info"

# --- Fixed values: line classification ----------------------------------------

LINE_COMMENT_PREFIXES = ("//", "#", "--", "*")

# Code points with the Unicode White_Space property.
WHITE_SPACE = (
    "\t\n\u000b\f\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
