"""Language registry: which extension belongs to which language and role.

The tables are plain text so that a user can read and extend them; ``Registry`` turns them
into literal sets (used inside ``isin``) and small dimension tables (used in broadcast joins).
"""
from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values -------------------------------------------------------------------
IGNORE_DIRS = """
node_modules .git dist build __pycache__ .venv venv .env .idea .vscode target out bin obj
.gradle .mvn vendor Pods .dart_tool .pub-cache coverage .nyc_output .pytest_cache htmlcov
""".split()

BINARY_EXTS = """
.exe .dll .so .dylib .bin .out .png .jpg .jpeg .gif .ico .webp .bmp .tiff .svg .pdf .zip .tar
.gz .7z .rar .bz2 .xz .mp3 .mp4 .avi .mov .wav .ogg .flac .pyc .pyo .pyd .class .o .a .woff
.woff2 .eot .ttf .otf .db .sqlite .sqlite3 .lock
""".split()

CONFIG_EXTS = ".yaml .yml .toml .ini .cfg .conf .env .xml .properties".split()

DOC_EXTS = ".md .txt .rst .adoc .asciidoc .tex .latex .rtf".split()

# language | role | extensions | entry points | build files
LANGUAGES = """
python | backend | .py .pyw .pyi | main.py app.py manage.py wsgi.py asgi.py server.py run.py | requirements.txt Pipfile pyproject.toml setup.py setup.cfg poetry.lock
javascript | frontend | .js .mjs .cjs | index.js app.js server.js main.js | package.json yarn.lock package-lock.json
typescript | frontend | .ts | index.ts app.ts main.ts server.ts | tsconfig.json package.json
jsx | frontend | .jsx | index.jsx app.jsx main.jsx | package.json
tsx | frontend | .tsx | index.tsx app.tsx main.tsx | tsconfig.json
vue | frontend | .vue | app.vue App.vue | package.json vue.config.js
svelte | frontend | .svelte | app.svelte App.svelte | svelte.config.js package.json
html | frontend | .html .htm .xhtml | index.html index.htm |
css | frontend | .css .scss .sass .less .styl | |
java | backend | .java | Main.java Application.java App.java | pom.xml build.gradle build.gradle.kts settings.gradle
kotlin | backend | .kt .kts | Main.kt Application.kt App.kt | build.gradle.kts settings.gradle.kts
csharp | backend | .cs | Program.cs Startup.cs Main.cs | .csproj .sln .nuspec packages.config
vbnet | backend | .vb | | .vbproj .sln
vb6 | backend | .bas .cls .frm .ctl .res .dsr | | .vbp .vbg
fsharp | backend | .fs .fsx .fsi | Program.fs Main.fs | .fsproj
go | backend | .go | main.go | go.mod go.sum Makefile
rust | backend | .rs | main.rs lib.rs | Cargo.toml Cargo.lock
cpp | backend | .cpp .cxx .cc .c++ .hxx .hpp | main.cpp main.cxx main.cc | CMakeLists.txt Makefile configure meson.build
c | backend | .c .h | main.c | CMakeLists.txt Makefile configure
swift | frontend | .swift | main.swift AppDelegate.swift App.swift ContentView.swift | Package.swift Podfile Cartfile
objective_c | frontend | .m .mm | main.m AppDelegate.m | Podfile Cartfile
ruby | backend | .rb .rake .gemspec | config.ru app.rb main.rb application.rb | Gemfile Gemfile.lock Rakefile
php | backend | .php .phtml .php3 .php4 .php5 | index.php app.php | composer.json composer.lock
scala | backend | .scala .sc | Main.scala App.scala | build.sbt project/build.properties
dart | frontend | .dart | main.dart app.dart | pubspec.yaml pubspec.lock
elixir | backend | .ex .exs | application.ex endpoint.ex | mix.exs mix.lock
erlang | backend | .erl .hrl | | rebar.config rebar3
haskell | backend | .hs .lhs | Main.hs | stack.yaml cabal.project package.yaml
cobol | backend | .cbl .cob .cpy .cobol .cob74 .cob85 | |
powerbuilder | backend | .pbl .pbd .pbw .pbt .srd .srf .srw .sra | | .pbw .pbt
abap | backend | .abap .prog.abap .clas.abap | |
fortran | backend | .f .f77 .f90 .f95 .f03 .for .ftn | |
pascal | backend | .pas .pp .dpr .dpk | | .dproj
lua | backend | .lua | main.lua init.lua | rockspec
r | backend | .r .R .rmd .Rmd | | DESCRIPTION NAMESPACE
julia | backend | .jl | main.jl | Project.toml Manifest.toml
matlab | backend | | |
sql | backend | .sql .ddl .dml .prc .sp .fnc | |
shell | backend | .sh .bash .zsh .fish .ksh .csh | |
powershell | backend | .ps1 .psm1 .psd1 | |
perl | backend | .pl .pm .pod | | Makefile.PL Build.PL cpanfile
groovy | backend | .groovy .gvy .gy .gsh | | build.gradle
clojure | backend | .clj .cljs .cljc .edn | | project.clj deps.edn
terraform | backend | .tf .tfvars | main.tf |
dockerfile | config | | Dockerfile docker-compose.yml docker-compose.yaml |
graphql | backend | .graphql .gql | |
proto | backend | .proto | |
jupyter | backend | .ipynb | |
assembly | backend | .asm .s .nasm .masm | |
"""

# directory names that give a source file its structural role, in order of precedence
STRUCTURE_DIRS = {
    "routes": "routes route pages page views view controllers api".split(),
    "components": "components component ui widgets atoms molecules".split(),
    "constants": "constants constant consts config configs".split(),
    "types": "types type models model schemas schema entities interfaces".split(),
    "services": "services service utils util lib helpers hooks store".split(),
}
STRUCTURE_SKIP_DIRS = ".git node_modules __pycache__ .idea .vscode dist build .next out".split()

# the ladder of file categories after entry points and config: (category, dirs, name words)
CATEGORY_LADDER = [
    ("route", "routes route controllers controller api routers".split(), ["route", "controller"]),
    ("service", "service services logic usecase usecases providers core".split(), ["service", "logic"]),
    ("component", "components component views view pages page ui templates layouts".split(), ["component"]),
]
CONFIG_NAME_WORDS = ["config", "settings", "setup"]
CONFIG_DIRS = ["config", "configs", "settings", ".idea", ".vscode"]

NEGATIVE_PATH = r"(?i)(^|/)(test[s_]?|spec[s_]?|mock[s_]?|fixture[s_]?|stub[s_]?|fake[s_]?|__test__|__spec__|__mock__|example[s_]?|sample[s_]?|demo[s_]?)"
BUSINESS_PATH = r"(?i)(scor|rule|validat|pric|fee|tax|discount|policy|workflow|engine|calculat|analyz|analys|classif|rank|weight|threshold|constant|schema)"
# ---- end of fixed values --------------------------------------------------------------


@dataclass(frozen=True)
class Registry:
    """Literal view of a language registry; small by construction (see ``from_rows``)."""

    lang_ext: tuple = ()       # (ext, language, role, tier), one row per extension
    entry_points: tuple = ()   # lower-case file names
    build_files: tuple = ()    # lower-case file names
    languages: tuple = ()      # (language, role, tier)
    ignore_dirs: tuple = tuple(IGNORE_DIRS)
    binary_exts: tuple = tuple(BINARY_EXTS)
    config_exts: tuple = tuple(CONFIG_EXTS)
    doc_exts: tuple = tuple(DOC_EXTS)

    def exts_with_role(self, role):
        return [e for e, _, r, _ in self.lang_ext if r == role]

    @property
    def source_exts(self):
        return [e for e, _, _, _ in self.lang_ext]

    def with_inferred(self, rows):
        """Add (ext, language, role) rows of the learned tier; a curated extension stays."""
        known = {e for e, _, _, _ in self.lang_ext}
        extra, langs = [], []
        for ext, language, role in sorted(rows):
            if ext.lower() not in known:
                known.add(ext.lower())
                extra.append((ext.lower(), language, role, "inferred"))
                langs.append((language, role, "inferred"))
        return Registry(self.lang_ext + tuple(extra), self.entry_points, self.build_files,
                        self.languages + tuple(langs), self.ignore_dirs, self.binary_exts,
                        self.config_exts, self.doc_exts)


def _parse():
    out = []
    for line in LANGUAGES.strip().splitlines():
        name, role, exts, entries, builds = (part.strip() for part in line.split("|"))
        out.append((name, role, exts.split(), entries.split(), builds.split()))
    return out


def default_registry() -> Registry:
    seen, ext_rows = set(), []
    entries, builds = [], []
    for name, role, exts, entry, build in _parse():
        for ext in (e.lower() for e in exts):
            if ext not in seen:
                seen.add(ext)
                ext_rows.append((ext, name, role, "curated"))
        entries += [e.lower() for e in entry]
        builds += [b.split("/")[-1].lower() for b in build]
    return Registry(tuple(ext_rows), tuple(dict.fromkeys(entries)), tuple(dict.fromkeys(builds)),
                    tuple((n, r, "curated") for n, r, *_ in _parse()))


REGISTRY = default_registry()
