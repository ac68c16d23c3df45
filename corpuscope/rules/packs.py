"""Analysis packs, archetypes and business signals: data that drives scoring and voting."""
from __future__ import annotations

# ---- fixed values -------------------------------------------------------------------
# pack -> (threshold, evidence flags, dependency keywords, file globs)
PACKS = {
    "cli_tool": (0.6, [],
        "click typer fire argparse docopt cobra clap commander yargs clippy thor optparse".split(),
        "**/cli.py **/cli/** **/cmd/** **/commands/** **/main.go".split()),
    "data_platform": (0.5, ["has_database"],
        """airflow apache-airflow dbt dbt-core pyspark apache-spark kafka apache-kafka flink dagster prefect
        luigi celery bigquery snowflake redshift duckdb clickhouse delta-lake iceberg""".split(),
        "**/dags/** **/dbt_project.yml **/models/**/*.sql **/pipelines/** **/etl/** **/airflow/** **/spark/**".split()),
    "ml_pipeline": (0.5, [],
        """scikit-learn sklearn torch pytorch tensorflow keras xgboost lightgbm transformers huggingface
        datasets mlflow wandb optuna catboost jax flax""".split(),
        "**/*.ipynb **/models/** **/training/** **/notebooks/** **/experiments/** **/model_* **/train_*".split()),
    "mobile_app": (0.5, ["has_android", "has_ios"],
        """react-native flutter expo ionic capacitor swiftui uikit jetpack compose kotlin-multiplatform
        xamarin maui""".split(),
        "**/AndroidManifest.xml **/*.xcodeproj **/Podfile **/pubspec.yaml **/app.json **/Info.plist".split()),
    "web_api": (0.5, ["has_http_api", "has_grpc"],
        """fastapi flask django express koa hapi nestjs spring spring-boot gin actix-web fiber rails sinatra
        phoenix""".split(),
        "**/routes/** **/controllers/** **/*.proto **/swagger* **/openapi* **/api/**".split()),
    "powerbuilder_desktop": (0.5, ["has_desktop"],
        "appeon powerbuilder pb ribbonbar".split(),
        "**/*.sr* **/*.pbl **/*.sru **/*.xml **/*Ribbon*.xml **/README* **/*.pbr".split()),
    "react_docker_frontend": (0.5, ["has_docker"],
        """react react-dom typescript vite tailwindcss pdfjs-dist react-dropzone @react-router/node
        @react-router/serve""".split(),
        "**/Dockerfile **/docker/** **/package.json **/README* **/src/**/*.{js,jsx,ts,tsx}".split()),
}
# pack -> {section: hint}
PACK_HINTS = {
    "cli_tool": {
        "section_5": "Focus on command hierarchy, subcommands, flags/options, and input/output formats",
        "section_6": "Emphasise CLI response time, helpful error messages, and shell completion support",
        "section_8": "Document distribution method (pip, brew, go install, cargo, npm) and OS compatibility"},
    "data_platform": {
        "section_5": "Focus on data pipeline stages: ingest, transform, load, quality checks, scheduling",
        "section_6": "Include data freshness SLAs, pipeline uptime targets, and retry policies",
        "section_7": "Emphasise data schemas, source system contracts, and data quality dimensions",
        "section_8": "Document orchestration tools, compute infrastructure, and storage tiers"},
    "ml_pipeline": {
        "section_5": "Focus on ML pipeline stages: data ingestion, feature engineering, training, evaluation, serving",
        "section_6": "Include model accuracy targets, inference latency SLAs, retraining frequency",
        "section_7": "Emphasise training data requirements, data quality standards, and data versioning",
        "section_8": "Document ML infrastructure: GPU requirements, model registry, experiment tracking"},
    "mobile_app": {
        "section_5": "Focus on screen flows, user journeys, permissions, and platform-specific features",
        "section_6": "Include app startup time targets, crash-free rate, battery impact SLAs",
        "section_8": "Document mobile frameworks, state management, and CI/CD for app stores",
        "section_12": "Include App Store/Play Store compliance, data privacy (GDPR/CCPA), and permissions justification"},
    "web_api": {
        "section_5": "Focus on endpoint contracts, request/response schemas, error codes, and API versioning strategy",
        "section_6": "Emphasise latency SLAs, throughput targets, and rate limiting policies",
        "section_8": "Highlight API gateway, load balancer, and reverse proxy components",
        "section_12": "Include OWASP API Security Top 10 and TLS enforcement"},
    "powerbuilder_desktop": {
        "section_5": "List functional requirements around RibbonBar loading, dynamic menu creation, and Clicked event handlers for child controls.",
        "section_8": "Specify tech stack: PowerBuilder (Appeon), target Windows desktop runtime, UI resource files (Ribbon XML) and any build artifacts (.pbl/.sr*)"},
    "react_docker_frontend": {
        "section_5": "List UI features (PDF resume parsing, dropzone uploads, routing) and component contracts (props/events).",
        "section_8": "Document tech stack: React + TypeScript, Vite build, Tailwind, Docker setup, and any native browser APIs or third-party libs (pdfjs-dist)."},
}
# non-functional emphasis of the pack that has notes only and no signal rules
PACK_EMPHASIS = {
    "cli_tool": "command_response_time error_messages_clarity help_documentation exit_codes".split(),
}

# archetype -> (keywords, display, fragment), in registry order
ARCHETYPES = {
    "social_platform": ("social feed follow friend tweet post content notification".split(),
        "Social Platform", "social networking and content-sharing platform"),
    "api_backend_service": ("rest_api routing grpc protocol_buffer endpoint controller".split(),
        "API Backend Service", "backend API service exposing structured endpoints"),
    "data_platform": ("database data_access search query etl pipeline".split(),
        "Data Platform", "data management and query platform"),
    "auth_service": ("authentication auth credential token session identity".split(),
        "Authentication Service", "authentication and credential management service"),
    "e_commerce": ("payment cart checkout billing product order".split(),
        "E-Commerce System", "e-commerce and payment processing system"),
    "devops_toolchain": ("ci_cd container orchestration deployment build pipeline".split(),
        "DevOps Toolchain", "DevOps and deployment automation toolchain"),
    "desktop_ui_app": ("""ribbon mdi theme window control datawindow powerserver largebutton toolbar menubar
        dialog form widget""".split(),
        "Desktop UI Application", "desktop rich-client application with a graphical user interface"),
    "ml_ai_platform": ("model inference training embedding prediction classifier llm prompt".split(),
        "ML / AI Platform", "machine learning and AI-powered analytical platform"),
    "mobile_app": ("screen navigation gesture push_notification offline biometric".split(),
        "Mobile Application", "cross-platform mobile application"),
    "iot_edge": ("sensor telemetry firmware mqtt edge device gateway".split(),
        "IoT / Edge Platform", "Internet-of-Things edge computing platform"),
    "reporting_analytics": ("report dashboard chart kpi metric analytics visualisation visualization".split(),
        "Reporting & Analytics Tool", "business intelligence and reporting analytics tool"),
    "cms_content": ("article media slug publish draft cms blog rich_text".split(),
        "Content Management System", "content management and publishing platform"),
    "erp_enterprise": ("invoice ledger procurement inventory payroll hr erp crm".split(),
        "Enterprise Resource Planning (ERP)", "enterprise resource planning and business process management system"),
}
NO_ARCHETYPE = ("software_system", "Software System", "multi-capability software system")
INFRA_WORDS = ["container", "ci_cd", "test", "deploy", "docker", "kubernetes"]
TEST_WORDS = ["test", "spec", "assert"]

USER_WORDS = [
    ("admin", "Administrators"), ("dashboard", "System Operators"), ("auth", "Authenticated Users"),
    ("customer", "Customers"), ("client", "Clients"), ("patient", "Patients"), ("vet", "Veterinarians"),
    ("student", "Students"), ("payment", "Subscribers"), ("developer", "Developers"), ("api", "API Consumers"),
]
PRODUCT_WORDS = [
    ("dashboard", "Analytics Platform"), ("auth", "Identity Management System"),
    ("payment", "E-Commerce/Billing System"), ("tweet", "Social Platform"),
    ("post", "Content/Social Platform"), ("feed", "Content Distribution System"),
    ("api", "API Backend Service"), ("clinic", "Clinic Management System"),
    ("booking", "Booking/Reservation System"), ("data", "Data Management Platform"),
    ("search", "Search/Discovery Platform"),
]
ACRONYMS = {"CI": "CI", "CD": "CD", "CICD": "CI/CD", "GRPC": "gRPC", "REST": "REST", "API": "API",
            "SQL": "SQL", "DB": "DB", "JWT": "JWT", "URL": "URL", "HTTP": "HTTP", "HTTPS": "HTTPS",
            "ETL": "ETL", "RPC": "RPC"}

# feature names that are merged: name -> display name of the group
MERGE_GROUPS = {
    "container_orchestration_config": "Container Orchestration & CI/CD Config",
    "ci_cd_pipeline_config": "Container Orchestration & CI/CD Config",
    "token_based_authentication": "Authentication & Credential Management",
    "secret_credential_management": "Authentication & Credential Management",
    "domain_entity_modelling": "Domain Model & Service Layer",
    "domain_service_layer": "Domain Model & Service Layer",
}

MODULE_NOISE = """.idea .vscode .git .gradle .github .husky node_modules build dist out target bin obj
vendor tmp temp logs coverage __pycache__""".split()
CORE_MODULE_WORDS = "src app lib main backend frontend source core".split()

# path fragment -> feature category, first match wins
CATEGORY_FRAGMENTS = [
    ("api", "api"), ("routes", "api"), ("endpoints", "api"), ("main", "core_pipeline"),
    ("pipeline", "core_pipeline"), ("runner", "core_pipeline"), ("eca", "core_pipeline"),
    ("scanner", "core_pipeline"), ("classifier", "core_pipeline"), ("processor", "core_pipeline"),
    ("aggregator", "core_pipeline"), ("normalizer", "core_pipeline"), ("validator", "core_pipeline"),
    ("builder", "feature_detection"), ("context", "feature_detection"), ("output", "core_pipeline"),
    ("schema", "core_pipeline"),
]
CATEGORY_PRIORITY = {"core_pipeline": "High", "api": "High", "feature_detection": "Medium", "unknown": "Low"}

# component layer of a feature by name fragments, first match wins
LAYERS = [
    ("API / Routing Layer", ["api", "routing", "controller"]),
    ("Data Access Layer", ["db", "database", "data", "repo"]),
    ("Domain Service Layer", ["service", "logic"]),
    ("Presentation Layer", ["ui", "frontend", "view"]),
    ("Security Layer", ["auth", "security"]),
    ("Testing Suite", ["test"]),
]
DOMAIN_WORDS = ["entity", "model", "management", "system"]
STACK_SKIP_CATEGORIES = ["testing", "build"]
STACK_SKIP_NAMES = ["jvm-target", "application", "android", "serialization"]

# purpose of a technology by fragment of its name, first match wins; the labels of the two lists differ
PURPOSE_TOKEN = [line.split(" = ", 1) for line in """
kotlin = Primary programming language
python = Primary programming language
javascript = Primary programming language
typescript = Typed superset of JavaScript
java = Primary programming language
go = Primary programming language
scala = Functional/OO language on the JVM
rust = Systems-level language
swift = Primary programming language (iOS/macOS)
ruby = Primary programming language
csharp = Primary programming language (.NET)
gradle = Build automation and dependency management
maven = Build automation and dependency management
npm = Package manager for JavaScript
pip = Package manager for Python
cargo = Package manager for Rust
android = Target mobile platform
ios = Target mobile platform
web = Target web platform
desktop = Target desktop platform
server = Server-side / backend platform
docker = Containerisation — packages the app for consistent deployment
kubernetes = Container orchestration — manages deployment at scale
spring = Java/Kotlin web application framework
react = User interface library
angular = Frontend application framework
vue = Frontend application framework
django = Python web framework
flask = Lightweight Python web framework
fastapi = High-performance Python API framework
express = Node.js web framework
next = React-based full-stack framework
compose = Declarative UI toolkit
retrofit = Type-safe HTTP client
okhttp = HTTP networking library
ktor = Asynchronous framework for Kotlin
coroutines = Asynchronous/concurrent programming library
serialization = Data serialisation library
hilt = Dependency injection framework
room = Android local database library
realm = Mobile-first database
postgres = Relational database
mysql = Relational database
mongo = Document-oriented database
redis = In-memory cache / data store
sqlite = Embedded relational database
kafka = Distributed message streaming platform
rabbitmq = Message broker
grpc = High-performance RPC framework
graphql = Query language for APIs
openai = AI/LLM integration
langchain = LLM orchestration framework
tensorflow = Machine learning framework
pytorch = Machine learning framework
junit = Unit testing framework
pytest = Python testing framework
jest = JavaScript testing framework
""".strip().splitlines()]
PURPOSE_SUBSTRING = [line.split(" = ", 1) for line in """
kotlin = Primary programming language
python = Primary programming language
javascript = Primary programming language
typescript = Typed superset of JavaScript for type-safe development
java = Primary programming language
go = High-performance backend language
rust = Systems-level language for performance-critical components
swift = Primary programming language (iOS/macOS)
ruby = Primary programming language
c# = Primary programming language (.NET)
csharp = Primary programming language (.NET)
scala = Functional/OO language on the JVM
gradle = Build automation and dependency management
maven = Build automation and dependency management (Java/Kotlin)
npm = Package manager for JavaScript/TypeScript
pip = Package manager for Python
cargo = Package manager and build tool for Rust
poetry = Python dependency and packaging manager
android = Target mobile platform (Android)
ios = Target mobile platform (iOS)
web = Target web platform
desktop = Target desktop platform
server = Server-side / backend platform
spring = Java/Kotlin enterprise web framework
react = Declarative UI library for web interfaces
angular = Frontend application framework
vue = Progressive frontend framework
svelte = Compile-time frontend framework
django = Python full-stack web framework
flask = Lightweight Python web framework
fastapi = High-performance async Python API framework
express = Minimal Node.js web framework
next = React-based full-stack framework
nuxt = Vue-based full-stack framework
compose = Declarative UI toolkit
ktor = Asynchronous web framework for Kotlin
retrofit = Type-safe HTTP client for Android/JVM
okhttp = HTTP + HTTP/2 client for JVM
coroutines = Asynchronous/concurrent programming library
lifecycle = Android lifecycle-aware components
hilt = Dependency injection framework (Android)
dagger = Dependency injection framework
room = Android SQLite abstraction library
serialization = Data serialisation library
coil = Image loading library for Android
glide = Image loading and caching library
postgres = Relational database
mysql = Relational database
mongo = Document-oriented NoSQL database
redis = In-memory cache and data store
sqlite = Embedded relational database
realm = Mobile-first embedded database
h2 = In-memory/embedded relational database (testing)
cassandra = Wide-column distributed database
kafka = Distributed message streaming platform
rabbitmq = Message broker
grpc = High-performance RPC framework
graphql = Query language for APIs
openai = OpenAI API integration (LLM)
langchain = LLM orchestration framework
tensorflow = Machine learning framework
pytorch = Machine learning framework
sklearn = Machine learning library (scikit-learn)
docker = Containerisation — packages app for consistent deployment
kubernetes = Container orchestration — manages deployment at scale
terraform = Infrastructure as code
ansible = Configuration management and automation
junit = Unit testing framework (JVM)
pytest = Python testing framework
jest = JavaScript testing framework
espresso = Android UI testing framework
""".strip().splitlines()]
PURPOSE_DEFAULT = "Supporting technology component"

# token -> language rules for learning unknown extensions: (token regex, language, role, hundredths)
LANGUAGE_TOKENS = [
    (r"(?m)^\s*(?:PROGRAM|IDENTIFICATION|PROCEDURE) DIVISION\.", "cobol", "backend", 85),
    (r"(?m)^#!.*\bpython", "python", "backend", 95),
    (r"(?m)^#!.*\b(?:ba)?sh\b", "shell", "backend", 95),
    (r"(?m)^\s*def \w+\(.*\):", "python", "backend", 80),
    (r"(?m)^\s*package main\b", "go", "backend", 90),
    (r"(?m)^\s*public class \w+", "java", "backend", 80),
    (r"(?i)<html\b", "html", "frontend", 80),
    (r"(?i)\bselect\b.+\bfrom\b", "sql", "backend", 60),
]
# ---- end of fixed values --------------------------------------------------------------
