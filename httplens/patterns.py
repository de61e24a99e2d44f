"""Search patterns, word lists and formats that decide results.

Every text below is a fixed value of the data model or of an analysis and has to
stay as it is for results to be right. Patterns are regular expressions whose
alternatives are separated by ``|``; they are searched for anywhere in the text.
"""

# --- fixed values: path and text patterns -----------------------------------

LOGIN_PATHS = r"login|signin|auth|oauth|sso|saml|token|session|logout|register|signup"

PRIVILEGED_PATHS = r"admin|manager|superuser|root|internal|private|restricted|staff|moderator"

SENSITIVE_WORDS = r"password|passwd|secret|token|apikey|api_key|credential|ssn|credit"

INJECTION = r"union.{0,20}select|drop.{0,5}table|exec.{0,5}\(|<script|javascript:"

DEBUG_PATHS = (
    r"\.env|phpinfo|server-status|actuator|swagger|/api-docs|/openapi|/metrics|/health|debug|trace"
)

INTERNAL_URLS = (
    r"192\.168\.|10\.[0-9]+\.|172\.1[6-9]\.|127\.0|localhost|file://|dict://|gopher://"
)

SCRIPT_PAYLOADS = r"<script|javascript:|onerror=|onload=|alert\(|eval\(|document\.cookie"

SQL_PAYLOADS = r"union.{0,15}select|or.{0,5}1.{0,3}=.{0,3}1|drop.{0,5}table|; *--"

ENCODED_TRAVERSAL = r"\.\.%2f|\.\.%5c"

REDIRECT_PARAMS = r"redirect=|url=|next=|return=|rurl=|dest=|target=|forward=|goto="

SSRF_PARAMS = (
    r"ssrf|internal|intranet|192\.168\.|10\.[0-9]+\.|127\.0|localhost|file://|dict://"
)

INTERESTING_PATHS = (
    r"admin|debug|backup|upload|config|secret|token|password|\.env|swagger|graphql|actuator"
    r"|phpmyadmin|\.git|wp-admin|jenkins|kibana|passwd"
)

API_PATHS = r"/api/|/v1/|/v2/|/v3/|/rest/|/graphql"

UPLOAD_PATHS = r"upload|file|attach|import"

UNAUTHENTICATED_PATHS = r"admin|manager|internal|private|restricted|staff"

UNAUTHENTICATED_API_PATHS = r"admin|api|internal|private"

NUMERIC_SEGMENT = r"/[0-9]+"

# --- fixed values: header texts searched in the lower-cased header JSON ------

AUTH_HEADERS = r"authorization|x-api-key"
AUTHORIZATION_HEADER = r"authorization"
JSON_CONTENT = r"application/json"
MULTIPART_CONTENT = r"multipart"
CSRF_HEADERS = r"csrf|xsrf"

# --- fixed values: status codes and methods ---------------------------------

DENIED_STATUSES = (401, 403)
SAFE_METHODS = ("GET", "HEAD", "OPTIONS")
STATE_CHANGING_METHODS = ("POST", "PUT", "DELETE", "PATCH")

# --- fixed values: SQL blocks in chat replies -------------------------------

SQL_BLOCK = r"(?is)```(?:sql)?[ \t]*\n(.*?)```"

SQL_STARTS = ("SELECT", "WITH", "INSERT", "UPDATE", "DELETE", "CREATE")
SQL_MARKERS = (" FROM ", "\nFROM ")

CATEGORY_WORDS = (
    ("Authentication", (
        "401", "403", "AUTH", "LOGIN", "LOGOUT", "SESSION",
        "CREDENTIAL", "PASSWORD", "BEARER", "SIGN_IN", "REGISTER")),
    ("Errors & Leakage", (
        ">=500", ">= 500", "5XX", "SERVER_ERROR", "EXCEPTION", "STACK_TRACE")),
    ("Input Surface", (
        "REQ_BODY", "POST", "PUT", "PATCH", "PARAM", "BODY_LENGTH", "MULTIPART", "UPLOAD")),
    ("Security", (
        "SCRIPT", "INJECT", "XSS", "SQLI", "TRAVERSAL", "SSRF", "REDIRECT", "CSRF",
        "UNION SELECT", "DROP TABLE", "EXEC(", "EVAL(")),
    ("Recon", (
        "COUNT(*)", "GROUP BY", "DISTINCT", "HOST", "TIMELINE", "STRFTIME", "DATE_TRUNC")),
)
DEFAULT_CATEGORY = "AI Generated"

PREVIEW_LENGTH = 110
PREVIEW_KEPT = 107

# --- fixed values: texts of the digest and of error rows --------------------

EMPTY_DIGEST = "No traffic captured yet."
API_ERROR = "API error: "
NO_CONTENT = "No text content in response: "
EMPTY_BODY = "(empty response body)"
