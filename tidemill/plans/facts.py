"""Fixed values of the rules as the SQL twins use them: kept apart from the code that they check."""

# Fixed values.
FOLDS = {
    "a": "à á ả ã ạ ă ằ ắ ẳ ẵ ặ â ầ ấ ẩ ẫ ậ",
    "e": "è é ẻ ẽ ẹ ê ề ế ể ễ ệ",
    "i": "ì í ỉ ĩ ị y ỳ ý ỷ ỹ ỵ",
    "o": "ò ó ỏ õ ọ ô ồ ố ổ ỗ ộ ơ ờ ớ ở ỡ ợ",
    "u": "ù ú ủ ũ ụ ư ừ ứ ử ữ ự",
    "d": "đ",
}
SPACES = [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288]
CITIES = [
    ("hồ chí minh", "Ho Chi Minh"),
    ("ho chi minh", "Ho Chi Minh"),
    ("hcm", "Ho Chi Minh"),
    ("tp.hcm", "Ho Chi Minh"),
    ("tp hcm", "Ho Chi Minh"),
    ("tphcm", "Ho Chi Minh"),
    ("sài gòn", "Ho Chi Minh"),
    ("saigon", "Ho Chi Minh"),
    ("quận 1", "Ho Chi Minh"),
    ("quận 7", "Ho Chi Minh"),
    ("thủ đức", "Ho Chi Minh"),
    ("hà nội", "Ha Noi"),
    ("ha noi", "Ha Noi"),
    ("hanoi", "Ha Noi"),
    ("hn", "Ha Noi"),
    ("đà nẵng", "Da Nang"),
    ("da nang", "Da Nang"),
    ("danang", "Da Nang"),
    ("bình dương", "Binh Duong"),
    ("đồng nai", "Dong Nai"),
    ("hải phòng", "Hai Phong"),
    ("cần thơ", "Can Tho"),
    ("bắc ninh", "Bac Ninh"),
    ("hưng yên", "Hung Yen"),
]
JOB_TYPES = [
    ("full-time", "full_time"),
    ("full time", "full_time"),
    ("toàn thời gian", "full_time"),
    ("part-time", "part_time"),
    ("part time", "part_time"),
    ("bán thời gian", "part_time"),
    ("contract", "contract"),
    ("hợp đồng", "contract"),
    ("internship", "internship"),
    ("thực tập", "internship"),
    ("remote", "remote"),
    ("từ xa", "remote"),
    ("work from home", "remote"),
    ("freelance", "freelance"),
]
EDGED_SKILLS = "sql aws gcp k8s dbt vue git ai nlp etl elt go c++ c# api".split()
PLAIN_SKILLS = [
    *"python java javascript typescript nosql azure docker kubernetes spark hadoop kafka airflow postgresql mysql mongodb redis".split(),
    *"elasticsearch react angular node.js nodejs terraform ansible jenkins ci/cd".split(),
    *["machine learning", "deep learning", "data engineer", "data analyst", "data scientist", "data pipeline", "data warehouse"],
    *["tableau", "power bi", "looker", "superset", "scala", "golang", "rust", ".net", "linux", "agile", "scrum", "microservices"],
    *["big data", "data lake", "snowflake", "redshift", "bigquery"],
]
NEGOTIABLE = ["thỏa thuận", "thương lượng", "negotiable", "cạnh tranh"]
SEED_KEYWORDS = ["software engineer", "data engineer", "kế toán", "marketing", "nhân sự"]
DISPLAY = [("itviec", "ITviec"), ("careerlink", "CareerLink"), ("vieclam24h", "ViecLam24h"), ("jooble", "Jooble"), ("careerviet", "CareerViet"), ("timviec365", "TimViec365")]
