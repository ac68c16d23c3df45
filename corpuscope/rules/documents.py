"""Requirement templates, report texts and the rules that score and repair documents."""
from __future__ import annotations

# ---- fixed values -------------------------------------------------------------------
# feature -> [(description, acceptance criteria)]
FR_TEMPLATES = {
    "database_access_layer": [
        ("The system SHALL execute CRUD operations against the primary datastore.",
         ["Verify that create, read, update, and delete operations succeed against the test database.",
          "Verify that operations on non-existent records return an explicit Not Found error (e.g., HTTP 404)."]),
        ("The system SHALL enforce database connection pooling to handle concurrent requests.",
         ["Verify that maximum active connections do not exceed the configured limit during load testing."])],
    "authentication_credential_management": [
        ("The system SHALL validate user credentials and issue a signed authentication token upon success.",
         ["Verify that valid credentials return HTTP 200 with a valid token payload.",
          "Verify that invalid credentials return HTTP 401 Unauthorized."]),
        ("The system SHALL reject requests to protected endpoints if the authentication token is missing or expired.",
         ["Verify that a request without an Authorization header returns HTTP 401.",
          "Verify that a request with an expired token returns HTTP 401."])],
    "rest_api_routing": [
        ("The system SHALL route incoming HTTP requests to their corresponding endpoint handlers.",
         ["Verify that registered endpoints return the expected HTTP status code for valid requests.",
          "Verify that requests to unregistered paths return HTTP 404 Not Found."])],
    "user_management": [
        ("The system SHALL allow creation of new user records with unique identifiers.",
         ["Verify that a new user record is successfully persisted when valid data is provided.",
          "Verify that creating a user with an already existing identifier (e.g., email) returns an HTTP 409 Conflict."])],
}
# {name} stands for the display name of the feature
FR_GENERIC = [
    ("The system SHALL expose an interface or endpoint to execute the {name} capability.",
     ["Verify that the {name} interface accepts correctly formatted input without error.",
      "Verify that malformed input is rejected with a structured error response."]),
    ("The system SHALL record an audit or standard log entry upon execution of the {name} capability.",
     ["Verify that a log entry containing the operation name and outcome is generated upon execution."]),
]

# (trigger group or None, category, description)
NFR_BASE = [
    ("performance", "The system SHALL respond to 95% of synchronous API requests within 500 milliseconds under normal load."),
    ("security", "The system SHALL encrypt all data in transit using TLS 1.2 or higher."),
    ("availability", "The system SHALL support graceful degradation, returning static or cached responses if downstream dependencies fail."),
]
NFR_BY_STACK = [
    ("database", ["db", "sql", "mongo", "database"], [
        ("performance", "The system SHALL execute primary key database queries in under 50 milliseconds at the 99th percentile."),
        ("availability", "The system SHALL persist automated database backups at least daily, retained for 30 days.")]),
    ("microservices", ["microservice", "kubernetes", "docker"], [
        ("scalability", "The system SHALL support horizontal scaling, allowing independent stateless instances to be added dynamically."),
        ("availability", "The system SHALL implement automated health checks and restart failed instances within 60 seconds.")]),
    ("frontend", ["react", "vue", "ui", "frontend"], [
        ("performance", "The frontend application SHALL achieve a Time to Interactive (TTI) of under 3 seconds on standard broadband connections.")]),
    ("cache", ["redis", "memcached", "cache"], [
        ("performance", "The system SHALL maintain a cache hit ratio of at least 80% for frequently accessed, read-heavy data endpoints.")]),
]
NFR_FILL = [
    ("security", "The system SHALL log all authentication failures and administrative actions to a centralized, append-only audit trail."),
    ("scalability", "The system SHALL decouple asynchronous background tasks from the main request thread using a message queue or task worker."),
]

HEADINGS = [
    "## 1. Executive Summary", "## 2. Business Context", "## 3. Current State Analysis",
    "## 4. Stakeholders", "## 5. Functional Requirements", "## 6. Non-Functional Requirements",
    "## 7. Data Requirements", "## 8. Technology Stack", "## 9. CI/CD Pipeline",
    "## 10. Infrastructure", "## 11. Risk Register", "## 12. Compliance",
    "## 13. Acceptance Criteria", "## 14. Delivery Roadmap", "## 15. Open Issues",
    "## 16. Document Approval",
]
# vague phrase -> precise phrase
CLARITY = {
    "should be fast": "SHALL respond within the defined latency threshold",
    "user-friendly": "operable without prior specialist training",
    "easy to use": "operable without prior specialist training",
    "seamlessly": "without manual intervention",
    "robust solution": "fault-tolerant system",
    "best-in-class": "conformant with the defined specification",
    "leveraging synergies": "sharing defined interfaces",
    "mission-critical": "required for primary system operation",
    "world-class": "conformant with the defined specification",
    "cutting-edge": "current generation",
    "bleeding-edge": "current generation",
    "state of the art": "current generation",
    "scalable and reliable": "horizontally scalable with defined availability targets",
    "highly scalable": "capable of horizontal scaling",
    "highly reliable": "designed with explicit fault-tolerance mechanisms",
    "as needed": "according to the specified schedule",
    "and so on": "(see full list in supporting documentation)",
    "etc.": "(see full list in supporting documentation)",
}
FR_ID = r"\bFR-\d+\b"
NFR_ID = r"\bNFR-\d+\b"
TESTABLE = r"(?i)\b(shall|must|will|ensures?|validates?|rejects?|returns?|generates?|creates?|authenticates?|authorizes?|logs?|records?|exposes?|accepts?|routes?)\b"
PLACEHOLDER = r"(?i)\b(strict|tbd|to be defined|to be determined|n/a|unspecified|pending)\b"
GENERIC_ROLES = ["end user", "end users", "admin", "administrator", "user", "users"]
PASS_MARK = 0.85
# (term, evidence flag)
GROUNDING = [
    ("Kubernetes", "has_kubernetes"), ("k8s", "has_kubernetes"), ("Docker", "has_docker"),
    ("Dockerfile", "has_docker"), ("GDPR", "has_gdpr_mention"), ("CCPA", "has_gdpr_mention"),
    ("REST API", "has_http_api"), ("RESTful", "has_http_api"), ("gRPC", "has_grpc"),
    ("Android", "has_android"), ("Google Play", "has_android"), ("App Store", "has_ios"), ("iOS", "has_ios"),
]
# grounding repair: (terms that trigger it, [(regex, replacement)] in order)
GROUNDING_REPAIR = [
    (["Kubernetes", "k8s"], [
        (r"(?i)\|[^|]*Kubernetes[^|]*\|[^|]*\|", "| Orchestration | Single-node application host process management |"),
        (r"(?i)\|[^|]*k8s[^|]*\|[^|]*\|", "| Orchestration | Single-node application host process management |"),
        (r"(?i)\bKubernetes\b", "single-node server"), (r"(?i)\bk8s\b", "single-node server")]),
    (["Docker", "Dockerfile"], [
        (r"(?i)\|[^|]*Docker[^|]*\|[^|]*\|", "| Deployment | Local application execution as a standard operating system process |"),
        (r"(?i)\bDocker\b", "standard process host"), (r"(?i)\bDockerfile\b", "configuration script")]),
    (["GDPR", "CCPA"], [
        (r"(?i)\bGDPR\b", "Standard Security Practices"), (r"(?i)\bCCPA\b", "Standard Security Practices")]),
    (["REST API", "RESTful"], [
        (r"(?i)\bREST APIs\b", "external data service interfaces"),
        (r"(?i)\bREST API\b", "external data service interface"),
        (r"(?i)\bRESTful\b", "external data service interface")]),
    (["gRPC"], [(r"(?i)\bgRPC\b", "REST HTTP API")]),
    (["Android", "Google Play"], [
        (r"(?i)\bAndroid\b", "web application client"), (r"(?i)\bGoogle Play\b", "web deployment portal")]),
    (["App Store", "iOS"], [
        (r"(?i)\biOS\b", "web application client"), (r"(?i)\bApp Store\b", "web deployment portal")]),
]
STUB_HEADINGS = [HEADINGS[i] for i in (1, 2, 3, 4, 5, 6, 10, 12)]

# report texts
CONTENTS = """1. Executive Summary
2. Business Context & Objectives
3. Current State Analysis (AS-IS)
4. Stakeholders & Personas
5. Functional Requirements
6. Non-Functional Requirements
7. Data Requirements
8. Technology Stack (TO-BE)
9. CI/CD Pipeline Requirements
10. Infrastructure Requirements
11. Risk Register
12. Compliance & Legal
13. Acceptance Criteria
14. Delivery Roadmap
15. Open Issues & Decisions
16. Document Approval""".splitlines()
PROBLEM = "The current system requires formal specification and modernization to ensure scalability, maintainability, and alignment with enterprise architecture standards."
GOALS = [
    ("G-01", "Architecture Modernization", "Ensure all components align with current target architecture"),
    ("G-02", "Code Quality & Coverage", "Achieve >80% automated test coverage across core modules"),
    ("G-03", None, None),
    ("G-04", "CI/CD Automation", "Establish zero-touch deployment pipelines"),
]
GOAL_AUTH = ("Security Hardening", "Secure authentication and authorization boundaries")
GOAL_NO_AUTH = ("Performance Optimization", "Ensure response times meet enterprise SLAs")
DEFAULT_SCOPE = ["Core application functionality", "Data persistence", "API routing"]
OUT_OF_SCOPE = ["Legacy system data migration (unless explicitly scripted)",
                "Third-party vendor platform modifications", "End-user hardware provisioning"]
FIXED_ROLES = [("Engineering Lead", "Architecture & Implementation", "High"),
               ("Product Owner", "Requirement Validation", "High"),
               ("DevOps / SRE", "Infrastructure & Operations", "Medium")]
DATA_ROWS = [
    ("Data Integrity", "ACID compliance for transactional data."),
    ("Backup Strategy", "Daily automated snapshots with 30-day retention."),
    ("Data Auditing", "Append-only audit logs for all mutations to domain entities."),
    ("Soft Deletion", "Records SHALL use `deleted_at` timestamps to prevent accidental loss."),
]
NO_DATA = ("No database dependencies were detected in this repository.",
           "Data retention policy not applicable — no persistence layer detected.")
DATA_POLICY = {
    "gdpr": ["PII Data: Encrypted at rest (AES-256). Subject to GDPR right-to-erasure workflows (evidenced by compliance mention in repository documentation).",
             "Application Logs: Hot storage for 30 days, cold archive for 1 year.",
             "Secrets: No secrets or API keys stored in plain text."],
    "auth": ["Credentials: Hashed using a strong one-way function (e.g., bcrypt). Never stored in plain text.",
             "Session Tokens: Short-lived; invalidated on logout.",
             "Secrets: No secrets or API keys stored in plain text."],
    "none": ["Data classification and retention policy requires manual definition. No PII or compliance signals were detected in the repository."],
}
INFRA_MOBILE = ("Mobile Application — No server infrastructure detected in this repository.", [
    ("Deployment", "Published via app store (Google Play / Apple App Store). No server-side provisioning required unless a backend service is added."),
    ("Backend API", "Not evidenced. Define in Open Issues (Section 15) if a backend is needed.")])
INFRA_DESKTOP = ("Desktop Application — Server infrastructure not applicable.", [
    ("Distribution", "Installer package (e.g., MSI, NSIS, pkg)."),
    ("Update Mechanism", "To be defined. Requires manual specification.")])
INFRA_NONE = ("Not evidenced — no container, cloud, or deployment configuration detected.", [
    ("Deployment Target", "Requires definition. No Dockerfile or infrastructure-as-code was detected."),
    ("High Availability", "To be defined based on chosen deployment target.")])
INFRA_ROWS = [
    ("High Availability", "Minimum 2 replicas deployed across availability zones."),
    ("Auto-scaling", "Configured based on CPU/Memory utilization thresholds."),
    ("Load Balancing", "Application Load Balancer with SSL termination."),
    ("Observability", "Centralized logging and metric collection."),
    ("Secret Management", "Runtime secret injection via secure vault."),
]
INFRA_K8S = "Kubernetes Cluster (evidenced by k8s manifests / Deployment YAML files in repository)"
INFRA_DOCKER = "Docker Containers (evidenced by Dockerfile in repository)"
INFRA_SERVERLESS = "Serverless Functions"
RISKS = [("Legacy Dependencies", "High", "Medium", "Execute automated vulnerability scans"),
         ("Test Coverage Deficiencies", "Medium", "High", "Enforce branch coverage metrics")]
# (flag or None, domain, requirement, strategy)
COMPLIANCE_ROWS = [
    ("has_gdpr_mention", "Data Privacy (GDPR/CCPA)", "Protection of PII — evidenced by compliance mention in repository docs.", "Encryption at rest, consent tracking."),
    ("has_auth", "Authentication Security", "Secure credential storage and session management.", "Password hashing, token expiry, rate limiting on auth endpoints."),
    ("has_http_api", "Security (OWASP)", "Defense against common web vulnerabilities.", "SAST/DAST in pipelines, input validation, parameterized queries."),
    ("has_http_api", "Network Security", "Secure data transit.", "TLS enforcement on all external endpoints."),
    (None, "Auditability", "Traceability of administrative actions.", "Immutable audit logs for all destructive operations."),
]
COMPLIANCE_NONE = ("Compliance Scope", "Not evidenced — no web endpoints, authentication, or data privacy signals detected. Requires manual definition based on deployment context.", "Define in Open Issues (Section 15).")
NO_INTERFACE = "No HTTP API routes or gRPC definitions were detected in this repository. If REST endpoints are required, add them as an Open Issue in Section 15."
ISSUE_FEW = "Low feature count detected; system boundaries may be incomplete or strictly microservice-scoped."
ISSUE_LOW = " subsystems generated low confidence signals requiring manual review by lead engineers."
ISSUE_STACK = "Technical stack could not be fully resolved; infrastructure assumptions must be validated."
ISSUE_NONE = "No immediate technical blockers identified from static analysis."
CICD_TOOLS = [("jenkins", "Jenkins"), ("gitlab", "GitLab CI"), ("github", "GitHub Actions")]
CICD_DEFAULT = "Enterprise CI/CD Tool (e.g., GitHub Actions, GitLab CI)"
CICD_LINES = """### 9.1 Pipeline Stages

- `Commit`
- `Lint & SAST`
- `Unit Tests`
- `Build / Containerize`
- `Integration Tests`
- `Deploy to Staging`
- `Manual Gate` _(approval required)_
- `Deploy to Prod`

### 9.2 Release Standards

| ID | Standard |
|---|---|
| CI-01 | All code merged to `main` SHALL pass automated tests and static analysis. |
| CI-02 | Build artifacts SHALL be immutable and uniquely versioned (e.g., Git SHA). |
| CI-03 | Infrastructure provisioning SHALL be fully automated (IaC). |
| CI-04 | Deployment rollback SHALL be executable within 5 minutes. |""".splitlines()
ACCEPTANCE_LINES = """### 13.1 Delivery Acceptance

- **Functional:** 100% of Must-Have Functional Requirements (Section 5) pass QA validation.
- **Non-Functional:** System demonstrates compliance with specified NFR SLAs (Section 6) under load testing.
- **Defects:** Zero P0 (Critical) or P1 (High) defects exist at the time of release candidate branching.

### 13.2 Operational Acceptance

- CI/CD pipelines successfully deploy the application to a production-like staging environment.
- Application metrics, logs, and alerts are verified in the centralized observability dashboard.
- Disaster recovery (backup restoration) runbook is documented and successfully tested.""".splitlines()
ROADMAP_LINES = """A phased modernization and delivery approach.

| Phase | Focus Area | Key Deliverables |
|---|---|---|
| **Phase 1: Foundation** | Infrastructure & CI/CD | Setup target environment, pipeline automation, and initial code migration. |
| **Phase 2: Core Refactor** | Backend & Data Layer | Address low-confidence modules, optimize data schemas, implement missing FRs. |
| **Phase 3: Hardening** | Security & Observability | Security audits, tracing integration, load testing. |
| **Phase 4: Transition** | Cutover & Go-Live | UAT sign-off, production deployment, legacy deprecation. |""".splitlines()
APPROVAL_LINES = """Signatures below indicate acceptance of the requirements outlined in this document.

| Role | Name | Signature | Date |
|---|---|---|---|
| Business Sponsor | | | |
| Product Owner | | | |
| Engineering Lead | | | |
| Security / Compliance | | | |""".splitlines()
# issue texts of a scored document: the parts around what is filled in
ISSUE_TEXTS = {
    "section": ("Missing required section: '", "'"),
    "feature": ("Feature '", "' from input is not referenced in the BRD."),
    "requirement": ("Functional requirement '", "' from input is not referenced in the BRD."),
    "phantom": ("BRD references '", "' which is NOT present in the input functional requirements. Potential hallucination."),
    "phrase": ("Banned vague phrase found in BRD: \"", "\". Replace with a specific, measurable statement."),
    "untestable": " does not contain a testable verb (SHALL, MUST, validates, returns, etc.). Requirement may not be verifiable.",
    "placeholder": " contains a placeholder SLA target ('Strict', 'TBD', etc.). Replace with a measurable value (e.g., '99.9% uptime', 'p99 < 200ms').",
    "no_stakeholders": "Stakeholder section contains no stakeholder entries.",
    "generic_roles": "Stakeholder section contains only generic roles ('End User', 'Admin'). Stakeholders should be project-specific (e.g., 'Billing Manager', 'Security Officer').",
    "summary": ("Executive Summary is too shallow (", " words). Should be ≥ 60 words with project-specific content."),
    "shallow": ("Section '", "' has insufficient content (", " words). Should be ≥ 30 words."),
    "ungrounded": ("[GROUNDING] BRD mentions '", "' but evidence key '", "' is False. This claim may not be supported by the repository."),
}
# ---- end of fixed values --------------------------------------------------------------
