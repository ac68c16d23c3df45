"""Signal rules: one row per regex, evaluated together in one pass over a file.

A rule is ``Rule(family, signal, regex, exts, group)``. ``group`` 0 means "does it occur",
1 means "each match gives a name".
"""
from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    family: str
    signal: str
    regex: str
    exts: tuple = ()
    group: int = 0


# ---- fixed values -------------------------------------------------------------------
WEB_EXTS = tuple(".py .js .ts .jsx .tsx .java .kt .go .rs .rb .proto .cs .ex .exs".split())
DATA_EXTS = tuple(".py .sql .yml .yaml .toml .cfg".split())
ML_EXTS = tuple(".py .ipynb .r .jl".split())
MOBILE_EXTS = tuple(".java .kt .swift .m .dart .js .jsx .ts .tsx .xml .plist .yaml .yml".split())
RN_EXTS = (".js", ".jsx", ".ts", ".tsx")
COMPOSE_EXTS = (".kt",)

SKIP_DIRS = {
    "web": "node_modules .git __pycache__ venv .venv vendor dist build .next target .gradle .idea".split(),
    "data": "node_modules .git __pycache__ venv .venv vendor dist build .next target .gradle".split(),
    "ml": "node_modules .git __pycache__ venv .venv vendor dist build .next target .gradle".split(),
    "mobile": "node_modules .git __pycache__ venv .venv vendor build dist .gradle .idea Pods .dart_tool".split(),
}
PACK_EXTS = {"web": WEB_EXTS, "data": DATA_EXTS, "ml": ML_EXTS, "mobile": MOBILE_EXTS}

# routes: (kind, regex); group 1 is the method, group 2 the path
ROUTE_REGEXES = [
    ("decorator", r"""(?i)@\w+\.(get|post|put|delete|patch|head|options)\s*\(\s*["']([^"']+)["']"""),
    ("express", r"""(?i)\b(?:app|router|server)\s*\.\s*(get|post|put|delete|patch)\s*\(\s*["'`]([^"'`]+)["'`]"""),
    ("spring", r"""(?i)@(Get|Post|Put|Delete|Patch|Request)Mapping\s*\(\s*(?:value\s*=\s*)?["']([^"']+)["']"""),
    ("go", r"""\b\w+\.(GET|POST|PUT|DELETE|PATCH)\s*\(\s*["']([^"']+)["']"""),
]
GRPC_NAME = r"(?i)rpc\s+(\w+)\s*\("
BOILERPLATE_PATHS = ["/health", "/healthz", "/metrics", "/docs", "/redoc", "/openapi.json"]

AUTH_RULES = [
    ("jwt", r"(?i)jwt\.decode|jwt\.verify|JwtModule|@UseGuards.*JwtAuth|Bearer\s+token"),
    ("jwt", r"(?i)jsonwebtoken|pyjwt|jose|JWTAuth|jwt_required"),
    ("oauth2", r"(?i)OAuth2|oauth2|authorization_code|client_credentials|OAuth2Scheme"),
    ("oauth2", r"(?i)passport\.authenticate|OAuth2Client"),
    ("session", r"(?i)session\.get|req\.session|@login_required|SessionAuthentication"),
    ("session", r"(?i)express-session|SessionMiddleware"),
    ("api_key", r"(?i)api[_-]?key|x-api-key|ApiKeyAuth|APIKeyHeader"),
    ("basic", r"(?i)BasicAuth|HTTPBasic|basic_auth|Authorization:\s*Basic"),
]
MIDDLEWARE_RULES = [
    ("cors", r"(?i)CORSMiddleware|cors\(\)|enable_cors|Access-Control-Allow"),
    ("rate_limiting", r"(?i)rate[_-]?limit|throttle|RateLimiter|express-rate-limit"),
    ("logging", r"(?i)LoggingMiddleware|morgan|winston|structlog|request_logger"),
    ("error_handler", r"(?i)@exception_handler|error[_-]?handler|@ControllerAdvice|app\.use.*err"),
    ("validation", r"(?i)@Body|@Valid|class-validator|marshmallow|pydantic"),
    ("compression", r"(?i)GZipMiddleware|compression\(\)|shrink-ray"),
]

AIRFLOW_DAG = r"""(?i)DAG\s*\(\s*["']([^"']+)["']"""
AIRFLOW_TASK = r"(?i)(\w+Operator|PythonOperator|BashOperator|SparkSubmitOperator|BigQueryOperator|PostgresOperator)\s*\("
DBT_REF = r"\{\{\s*ref\s*\(\s*['\"](\w+)['\"]\s*\)\s*\}\}"
DBT_SOURCE = r"\{\{\s*source\s*\(\s*['\"](\w+)['\"]"
DAGSTER = r"(?i)@(?:asset|op|job|graph|schedule|sensor)\b"
PREFECT = r"(?i)@(?:flow|task)\b"
LUIGI = r"(?i)class\s+(\w+)\s*\(.*(?:luigi\.Task|Task)\)"
SPARK_USE = r"(?i)SparkSession|spark\.read|spark\.sql|DataFrame|rdd\."
KAFKA_USE = r"(?i)KafkaProducer|KafkaConsumer|kafka\.consumer|kafka\.producer|bootstrap\.servers"

SOURCE_RULES = [
    ("postgresql", r"(?i)postgresql://|psycopg2|pg_connection|PostgresHook"),
    ("mysql", r"(?i)mysql://|pymysql|mysql\.connector|MySqlHook"),
    ("bigquery", r"(?i)bigquery|BigQueryHook|google\.cloud\.bigquery"),
    ("snowflake", r"(?i)snowflake\.connector|SnowflakeHook|snowflake://"),
    ("redshift", r"(?i)redshift|RedshiftHook|redshift-connector"),
    ("s3", r"(?i)boto3.*s3|S3Hook|s3://|aws_s3"),
    ("gcs", r"(?i)google\.cloud\.storage|GCSHook|gs://"),
    ("mongodb", r"(?i)pymongo|MongoClient|mongodb://"),
    ("elasticsearch", r"(?i)elasticsearch|Elasticsearch\(|es_client"),
    ("redis", r"(?i)redis\.Redis|aioredis|RedisHook"),
    ("csv_file", r"(?i)pd\.read_csv|\.csv['\"]|csv\.reader|csv\.writer"),
    ("parquet", r"(?i)\.parquet|read_parquet|to_parquet|pyarrow"),
]
QUALITY_RULES = [
    ("great_expectations", r"(?i)great_expectations|expect_column|ExpectationSuite|ge\.dataset"),
    ("dbt_tests", r"(?i)unique|not_null|accepted_values|relationships"),
    ("custom_assertion", r"(?i)assert\s+len|assert\s+\w+\s*[><=!]=|data_quality_check|validate_schema"),
    ("schema_validation", r"(?i)pydantic|marshmallow|cerberus|jsonschema|voluptuous"),
    ("null_check", r"(?i)isnull\(\)\.sum|notnull|dropna|fillna|missing_values"),
]

ML_STAGE_RULES = [
    ("data_loading", r"(?i)pd\.read_csv|pd\.read_parquet|pd\.read_json|load_dataset|DataLoader|read_csv"),
    ("data_loading", r"(?i)tf\.data\.Dataset|from_csv|from_parquet|ImageFolder"),
    ("data_preprocessing", r"(?i)StandardScaler|MinMaxScaler|LabelEncoder|OneHotEncoder|fit_transform"),
    ("data_preprocessing", r"(?i)train_test_split|cross_val_score|StratifiedKFold|KFold"),
    ("data_preprocessing", r"(?i)fillna|dropna|normalize|tokenize|Tokenizer"),
    ("feature_engineering", r"(?i)PolynomialFeatures|SelectKBest|PCA|TruncatedSVD|feature_importance"),
    ("feature_engineering", r"(?i)get_dummies|create_features|FeatureUnion|ColumnTransformer"),
    ("model_definition", r"(?i)class\s+\w+\(nn\.Module\)|class\s+\w+\(tf\.keras\.Model\)"),
    ("model_definition", r"(?i)Sequential\(\)|compile\(|Model\(inputs=|nn\.Linear|nn\.Conv2d"),
    ("model_definition", r"(?i)RandomForest|GradientBoosting|XGBClassifier|LGBMClassifier|LogisticRegression"),
    ("model_training", r"(?i)model\.fit|model\.train|trainer\.train|\.backward\(\)|optimizer\.step"),
    ("model_training", r"(?i)for\s+epoch|num_epochs|training_loop|loss\.backward"),
    ("model_evaluation", r"(?i)model\.eval|model\.evaluate|accuracy_score|f1_score|classification_report"),
    ("model_evaluation", r"(?i)confusion_matrix|roc_auc_score|mean_squared_error|r2_score"),
    ("model_serving", r"(?i)torch\.save|model\.save|joblib\.dump|pickle\.dump|onnx\.export"),
    ("model_serving", r"(?i)mlflow\.log_model|bentoml|TFServing|triton|torchserve"),
    ("model_serving", r"(?i)predict_endpoint|inference|@app\.\w+.*predict"),
    ("experiment_tracking", r"(?i)mlflow\.log|wandb\.log|wandb\.init|neptune\.log|tensorboard"),
    ("experiment_tracking", r"(?i)optuna\.create_study|hyperopt|ray\.tune"),
]
ML_STAGE_TEXT = {
    "data_loading": "Data ingestion and loading from files, databases, or APIs",
    "data_preprocessing": "Data cleaning, normalization, encoding, and train/test splitting",
    "feature_engineering": "Feature creation, selection, and dimensionality reduction",
    "model_definition": "Model architecture definition and configuration",
    "model_training": "Model training loop, optimization, and convergence monitoring",
    "model_evaluation": "Model performance evaluation and metric computation",
    "model_serving": "Model serialization, export, and serving infrastructure",
    "experiment_tracking": "Experiment logging, hyperparameter tracking, and reproducibility",
}
MODEL_TYPE_RULES = [
    ("neural_network_cnn", r"(?i)Conv2d|Conv1d|MaxPool|AveragePool|ResNet|VGG|InceptionV3"),
    ("neural_network_rnn", r"(?i)LSTM|GRU|RNN\(|Bidirectional|seq2seq"),
    ("transformer", r"(?i)Transformer|MultiHeadAttention|BertModel|GPT|attention_mask"),
    ("tree_ensemble", r"(?i)RandomForest|GradientBoosting|XGB|LGBM|CatBoost|DecisionTree"),
    ("linear_model", r"(?i)LogisticRegression|LinearRegression|Lasso|Ridge|ElasticNet|SGDClassifier"),
    ("clustering", r"(?i)KMeans|DBSCAN|AgglomerativeClustering|GaussianMixture"),
    ("generative", r"(?i)GAN|VAE|Diffusion|UNet|Generator|Discriminator"),
]
FRAMEWORK_RULES = [
    ("pytorch", r"(?i)import torch|from torch|nn\.Module"),
    ("tensorflow", r"(?i)import tensorflow|from tensorflow|tf\.keras"),
    ("scikit_learn", r"(?i)from sklearn|import sklearn"),
    ("huggingface", r"(?i)from transformers|AutoModel|AutoTokenizer|pipeline\("),
    ("xgboost", r"(?i)import xgboost|xgb\.XGB"),
    ("lightgbm", r"(?i)import lightgbm|lgb\.LGB"),
    ("jax", r"(?i)import jax|from jax|from flax"),
]
METRIC_RULES = [
    ("accuracy", r"(?i)accuracy_score|accuracy|\.acc\b"),
    ("f1_score", r"(?i)f1_score|f1-score|f1\b"),
    ("precision", r"(?i)precision_score|precision\b"),
    ("recall", r"(?i)recall_score|recall\b"),
    ("auc_roc", r"(?i)roc_auc|auc\b|roc_curve"),
    ("mse", r"(?i)mean_squared_error|mse\b"),
    ("rmse", r"(?i)rmse\b|root_mean_squared"),
    ("mae", r"(?i)mean_absolute_error|mae\b"),
    ("r2", r"(?i)r2_score|r_squared|R²"),
    ("loss", r"(?i)CrossEntropyLoss|BCELoss|MSELoss|loss\.item\(\)"),
    ("bleu", r"(?i)bleu_score|BLEU\b|corpus_bleu"),
    ("perplexity", r"(?i)perplexity|ppl\b"),
]

# screens: (type, regex, allowed extensions or () for every mobile extension)
SCREEN_RULES = [
    ("android_activity", r"(?i)class\s+(\w+)\s*(?:\(|:)\s*\w*(?:AppCompat)?(?:Activity|Fragment|ComponentActivity)", ()),
    ("ios_viewcontroller", r"(?i)class\s+(\w+)\s*:\s*(?:UI)?(?:ViewController|TableViewController|CollectionViewController|NavigationController)", ()),
    ("swiftui_view", r"(?i)struct\s+(\w+)\s*:\s*View\b", ()),
    ("flutter_screen", r"(?i)class\s+(\w*(?:Page|Screen|View)\w*)\s+extends\s+(?:Stateless|Stateful)Widget", ()),
    ("react_native_screen", r"(?i)(?:export\s+default\s+)?(?:function|class|const)\s+(\w*(?:Screen|Page)\w*)", RN_EXTS),
    ("compose_screen", r"(?i)@Composable\s+(?:fun|private\s+fun)\s+(\w*(?:Screen|Page|Content|View)\w*)\s*\(", COMPOSE_EXTS),
]
SCREEN_LABELS = {"android": "Android", "ios": "iOS", "swiftui": "SwiftUI", "flutter": "Flutter",
                 "react": "React Native", "compose": "Jetpack Compose"}
ANDROID_PERMISSION = r'(?i)<uses-permission\s+android:name="([^"]+)"'
IOS_PERMISSION = r"(?i)<key>(NS\w+UsageDescription)</key>"

# defects: (rule, regex, type, severity, text; {detail} stands for the rest of the comment)
DEFECT_RULES = [
    (r"(?i)//\s*TODO\b[:\s]*(.*)", "todo", "low", "TODO comment: {detail}"),
    (r"(?i)//\s*FIXME\b[:\s]*(.*)", "fixme", "medium", "FIXME comment: {detail}"),
    (r"(?i)//\s*HACK\b[:\s]*(.*)", "hack", "medium", "HACK comment: {detail}"),
    (r"(?i)@Deprecated\b", "deprecated_api", "medium", "Deprecated API usage detected."),
    (r"(?i)jcenter\s*\(\s*\)", "dead_repository", "critical", "jcenter() repository reference — permanently shut down since Feb 2022."),
    (r"(?i)Thread\.sleep\s*\(", "blocking_call", "medium", "Thread.sleep() in production code — can cause thread starvation."),
    (r"""(?i)password\s*=\s*["'][^"']+["']""", "hardcoded_credential", "critical", "Hardcoded password detected in source code."),
    (r"""(?i)api[_-]?key\s*=\s*["'][^"']+["']""", "hardcoded_credential", "critical", "Hardcoded API key detected in source code."),
    (r"(?i)extensions/v1beta1", "deprecated_k8s_api", "high", "Deprecated Kubernetes API version 'extensions/v1beta1' — removed in k8s 1.22+."),
    (r"(?i)apps/v1beta1|apps/v1beta2", "deprecated_k8s_api", "high", "Deprecated Kubernetes API version — use 'apps/v1' instead."),
]
SEVERITY_ORDER = ["critical", "high", "medium", "low"]
DEFECT_SKIP_DIRS = ".git node_modules .venv __pycache__ build target .gradle".split()
DEFECT_EXTS = """.kt .java .py .js .ts .go .rs .xml .yaml .yml .json .gradle .kts .properties .toml
.cfg .ini .proto .sql .dockerfile .sh .bat""".split()
DEFECT_NAMES = ["dockerfile", "makefile", "jenkinsfile"]

COMPLIANCE = r"(?i)\b(gdpr|ccpa|pii|personal\s+data|data\s+protection|right\s+to\s+erasure|data\s+subject|lawful\s+basis|privacy\s+policy|hipaa|sox|pci[-\s]dss)\b"
K8S_KIND = r"(?m)^kind\s*:\s*(Deployment|StatefulSet|Service|Ingress|Pod|DaemonSet|Job|CronJob)\b"

# manifests and code
GRADLE_PLUGIN = r"""(?i)(?:kotlin\s*\(\s*["'](\w+)["']\s*\)\s*version\s*["']([^"']+)["']|id\s*\(\s*["']([^"']+)["']\s*\)\s*version\s*["']([^"']+)["'])"""
GRADLE_EXT = r"""(\w+)[Vv]ersion\s*=\s*["']([^"']+)["']"""
GRADLE_DEP = r"""(?i)(?:implementation|api|compile|runtimeOnly|testImplementation)\s*[\('"]\s*([^:]+):([^:]+):([^"')]+)"""
GRADLE_JVM = r"""(?i)(?:sourceCompatibility|targetCompatibility|jvmTarget)\s*=\s*["']?([^"'\s]+)"""
JCENTER = r"(?i)\bjcenter\s*\(\s*\)"
MAVEN_GAV = r"<groupId>([^<]+)</groupId>\s*<artifactId>([^<]+)</artifactId>\s*<version>([^<]+)</version>"
MAVEN_PARENT = r"(?s)<parent>.*?<artifactId>([^<]+)</artifactId>.*?<version>([^<]+)</version>.*?</parent>"

# dependency categories by fragment of "group:artifact", first match wins
DEP_CATEGORY = [
    ("framework", ["spring-boot"]), ("language", ["kotlin", "jetbrains"]),
    ("communication", ["grpc", "protobuf"]),
    ("database", ["mysql", "postgres", "jdbc", "jpa", "hibernate"]),
    ("auth", ["firebase"]), ("testing", ["junit", "mockito", "test"]),
    ("infrastructure", ["docker", "kubernetes"]),
]
DEP_BUCKETS = [
    ("database", """jdbc jpa hibernate mysql postgres sqlite mongo sqlalchemy prisma sequelize typeorm
        room realm h2 mariadb mssql oracle redis cassandra""".split()),
    ("auth", """spring-security spring.security firebase jwt passport auth0 keycloak okta shiro pac4j
        nimbus-jose-jwt bcrypt argon2 django.contrib.auth""".split()),
    ("grpc", "grpc protobuf proto3 io.grpc".split()),
    ("infra", "docker kubernetes k8s helm".split()),
]

CONTROLLER_CLASS = r"(?s)@(?:Rest)?Controller\b.*?class\s+(\w+)"
CLASS_MAPPING = r"""@RequestMapping\s*\(\s*(?:value\s*=\s*)?["']([^"']+)["']"""
METHOD_MAPPING = r"""(?i)@(Get|Post|Put|Delete|Patch)Mapping\s*\(\s*(?:value\s*=\s*)?["']([^"']*?)["']"""
REQUEST_MAPPING = r"""(?is)@RequestMapping\s*\([^)]*method\s*=\s*\[?\s*RequestMethod\.(\w+)[^)]*value\s*=\s*["']([^"']+)["']"""
FUNCTION_NAME = r"(?:fun|public\s+\w+)\s+(\w+)\s*\("
PROTO_SERVICE = r"service\s+(\w+)\s*\{([^}]*(?:\{[^}]*\}[^}]*)*)\}"
PROTO_RPC = r"rpc\s+(\w+)\s*\(\s*(\w+)\s*\)\s*returns\s*\(\s*(\w+)\s*\)"
KOTLIN_DATA_CLASS = r"data\s+class\s+(\w+)\s*\(([^)]*)\)"
JPA_ENTITY = r"(?s)@Entity\b.*?(?:class|object)\s+(\w+)"
TABLE_NAME = r"""(?i)@Table\s*\(\s*name\s*=\s*["'](\w+)["']"""
PROTO_MESSAGE = r"message\s+(\w+)\s*\{([^}]*)\}"
KOTLIN_FIELD = r"(?:val|var)\s+(\w+)\s*:"
JAVA_FIELD = r"(?:private|protected|public)\s+\w+\s+(\w+)\s*[;=]"
PROTO_FIELD = r"(?:string|int32|int64|bool|float|double|bytes|\w+)\s+(\w+)\s*=\s*\d+"
FIELD_NOISE = ["serialVersionUID", "Companion"]

MODEL_EXTS = ".py .java .kt .proto .go .rs .ts .js .cs .rb .php".split()
MODEL_PATH_SKIP = ["test", "node_modules", "venv", ".git", "dist", "build"]
MODEL_WORDS = ["class ", "struct ", "interface "]
MODEL_WORDS_LOWER = ["db.model", "schema", "entity", "@table", "jpa", "mongoose", "prisma", "gorm", "diesel"]

KEYWORD_FEATURES = [
    ("Authentication", "auth login signup jwt session passport".split()),
    ("Database", "db database sql mongo postgres redis models schema".split()),
    ("API", "api routes controllers endpoints graphql rest".split()),
    ("Payment", "payment stripe billing checkout cart".split()),
    ("Search", "search elastic query filter".split()),
    ("User Management", "user profile account settings role".split()),
]
README_NAMES = "README.md readme.md README.rst readme.rst README.txt readme.txt README readme".split()
ENTRY_NAMES = """main.py app.py server.py index.py index.ts index.tsx main.ts main.tsx server.js index.js
app.js main.go""".split()
SNIPPET_ENTRY_NAMES = ["index.tsx", "main.py", "app.py", "index.ts"]
SNIPPET_MODEL_DIRS = ["/types/", "/models/", "/schemas/", "/interfaces/"]
DOCKER_NAMES = "Dockerfile dockerfile docker-compose.yml docker-compose.yaml compose.yml compose.yaml".split()
K8S_DIRS = "k8s kubernetes helm charts".split()
AUTH_DIRS = "auth security authentication authorization identity".split()
TEST_DIRS = "test tests __tests__ spec".split()
TEST_FILE = r"(Test\.kt|Test\.java|_test\.py|\.spec\.ts|\.test\.ts|\.test\.js)$"
IOS_FILE = r"(\.xcodeproj|\.xcworkspace)$"
DESKTOP_FILE = r"\.(pbl|pbt|pbw|sln|csproj)$"
PB_SOURCE_EXTS = [".srp", ".sru", ".pbl", ".pbd", ".pbr", ".pb", ".w"]
CHUNK_CHARS = 3200
# ---- end of fixed values --------------------------------------------------------------


def presence_rules() -> list[Rule]:
    """Every family that asks only whether a file mentions something."""
    rules = [Rule("middleware", s, rx, WEB_EXTS) for s, rx in MIDDLEWARE_RULES]
    rules += [Rule("auth", s, rx, WEB_EXTS) for s, rx in AUTH_RULES]
    rules += [Rule("orchestrator", s, rx, DATA_EXTS) for s, rx in [
        ("airflow", AIRFLOW_DAG), ("airflow", AIRFLOW_TASK), ("dbt", DBT_REF), ("dbt", DBT_SOURCE),
        ("dagster", DAGSTER), ("prefect", PREFECT), ("luigi", LUIGI), ("spark", SPARK_USE),
        ("kafka", KAFKA_USE)]]
    rules += [Rule("source", s, rx, DATA_EXTS) for s, rx in SOURCE_RULES]
    rules += [Rule("quality", s, rx, DATA_EXTS) for s, rx in QUALITY_RULES]
    rules += [Rule("stage", s, rx, ML_EXTS) for s, rx in ML_STAGE_RULES]
    rules += [Rule("model", s, rx, ML_EXTS) for s, rx in MODEL_TYPE_RULES]
    rules += [Rule("framework", s, rx, ML_EXTS) for s, rx in FRAMEWORK_RULES]
    rules += [Rule("metric", s, rx, ML_EXTS) for s, rx in METRIC_RULES]
    return rules


# which family belongs to which pack's file filter
FAMILY_PACK = {"middleware": "web", "auth": "web", "orchestrator": "data", "source": "data",
               "quality": "data", "stage": "ml", "model": "ml", "framework": "ml", "metric": "ml"}
