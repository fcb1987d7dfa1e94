"""The word lists and patterns that results depend on. Order matters wherever the first match wins."""

PROGRAMS = [
    ("cntt", "Công nghệ thông tin"),
    ("công nghệ thông tin", "Công nghệ thông tin"),
    ("an toàn thông tin", "An toàn thông tin"),
    ("attt", "An toàn thông tin"),
    ("khoa học máy tính", "Khoa học máy tính"),
    ("kỹ thuật phần mềm", "Kỹ thuật phần mềm"),
    ("ktpm", "Kỹ thuật phần mềm"),
    ("marketing", "Marketing"),
    ("thương mại điện tử", "Thương mại điện tử"),
    ("tmdt", "Thương mại điện tử"),
    ("điện tử viễn thông", "điện tử viễn thông"),
    ("dtvt", "điện tử viễn thông"),
    ("truyền thông đa phương tiện", "đa phương tiện"),
    ("multimedia", "đa phương tiện"),
    ("kế toán", "Kế toán"),
    ("quản trị kinh doanh", "Quản trị kinh doanh"),
    ("qtkd", "Quản trị kinh doanh"),
    ("khoa học dữ liệu", "Khoa học dữ liệu"),
    ("data science", "Khoa học dữ liệu"),
    ("quan hệ công chúng", "Quan hệ công chúng"),
    ("pr", "Quan hệ công chúng"),
    ("báo chí", "Báo chí"),
    ("iot", "Internet vạn vật"),
    ("trí tuệ nhân tạo", "Trí tuệ nhân tạo"),
    ("ai", "Trí tuệ nhân tạo"),
]
DOCUMENT_TAGS = [
    ("diem_chuan", ["điểm chuẩn", "điểm trúng tuyển", "điểm xét tuyển", "bảng điểm"]),
    ("hoc_phi", ["học phí", "mức học phí", "lệ phí"]),
    ("chi_tieu", ["chỉ tiêu tuyển sinh", "chỉ tiêu xét tuyển"]),
    ("nganh_hoc", ["mã ngành", "ngành đào tạo", "tổ hợp môn", "khối xét tuyển"]),
    ("xet_tuyen", ["xét tuyển", "phương thức xét tuyển", "nguyện vọng", "nhập học"]),
    ("hoc_bong", ["học bổng", "hỗ trợ tài chính"]),
    ("lich_tuyen_sinh", ["lịch tuyển sinh", "hạn nộp hồ sơ", "thời hạn đăng ký"]),
    ("gioi_thieu", ["sứ mạng", "tầm nhìn", "triết lý giáo dục"]),
]
QUERY_TAGS = [
    ("diem_chuan", ["điểm chuẩn", "diem chuan", "điểm trúng tuyển"]),
    ("nganh_hoc", ["ngành học", "nganh hoc"]),
    ("xet_tuyen", ["xét tuyển", "xet tuyen"]),
    ("dieu_kien_xet_tuyen", ["điều kiện xét tuyển", "dieu kien xet tuyen"]),
    ("chi_tieu", ["chỉ tiêu", "chi tieu"]),
    ("hoc_phi", ["học phí", "hoc phi"]),
    ("hoc_bong", ["học bổng", "hoc bong"]),
    ("co_hoi_viec_lam", ["cơ hội việc làm", "co hoi viec lam"]),
    ("lich_tuyen_sinh", ["lịch tuyển sinh", "lich tuyen sinh"]),
    ("info", ["thông tin", "info"]),
]
QUERY_TAGS_WIDE = [
    ("diem_chuan", ["điểm chuẩn", "diem chuan", "điểm trúng tuyển", "diem trung tuyen"]),
    ("hoc_phi", ["học phí", "hoc phi"]),
    ("chi_tieu", ["chỉ tiêu", "chi tieu"]),
    ("nganh_hoc", ["ngành", "nganh", "mã ngành", "ma nganh"]),
    ("xet_tuyen", ["xét tuyển", "xet tuyen"]),
    ("hoc_bong", ["học bổng", "hoc bong"]),
    ("ky_tuc_xa", ["ký túc xá", "ky tuc xa"]),
    ("lich_tuyen_sinh", ["lịch tuyển sinh", "lich tuyen sinh"]),
]
DOC_TYPES = [
    ("diem_chuan", "Điểm chuẩn"),
    ("hoc_phi", "Học phí"),
    ("chi_tieu", "Chỉ tiêu"),
    ("nganh_hoc", "Ngành học"),
    ("xet_tuyen", "Xét tuyển"),
    ("hoc_bong", "Học bổng"),
    ("ky_tuc_xa", "Ký túc xá"),
]
DOC_TYPE_DEFAULT = "Thông tin chung"
ACRONYMS = [
    ("HSA", "HSA (Đánh giá năng lực ĐHQGHN)"),
    ("APT", "APT (Đánh giá tư duy)"),
    ("SAT", "SAT (Scholastic Assessment Test)"),
    ("ACT", "ACT (American College Testing)"),
    ("TSA", "TSA (Đánh giá tư duy)"),
    ("SPT", "SPT (Đánh giá năng lực)"),
]
ADMISSION_CONTEXT = ["tuyển sinh", "xét tuyển", "điểm", "thang", "nguyện vọng", "đại học", "phương thức", "năng lực", "tư duy"]
FOOTERS = ["ĐỊA CHỈ HỌC VIỆN", "THÔNG TIN LIÊN HỆ", "VỀ CHÚNG TÔI", "ĐƯỜNG DẪN", "© Copyright", "All rights reserved"]
JUNK = ["xem chi tiết", "xem chi tiet", "facebook", "youtube", "admindaotao", "ptit"]
SCHOOLS = [
    ("ptit", "Học viện Công nghệ Bưu chính Viễn thông", ["ptit", "bưu chính", "buu chinh", "viễn thông", "vien thong", "học viện ptit"]),
    ("hust", "Đại học Bách Khoa Hà Nội", ["bách khoa", "bach khoa", "hust", "bkh", "đại học bách khoa", "dai hoc bach khoa"]),
    ("uet", "Đại học Công nghệ - ĐHQGHN", ["uet", "đại học công nghệ", "dai hoc cong nghe", "đhqghn", "dhqghn"]),
    ("neu", "Đại học Kinh tế Quốc dân", ["neu", "kinh tế quốc dân", "kinh te quoc dan", "đại học kinh tế", "dai hoc kinh te"]),
    ("ftu", "Đại học Ngoại thương", ["ftu", "ngoại thương", "ngoai thuong", "đại học ngoại thương", "dai hoc ngoai thuong"]),
    ("hcmut", "Đại học Bách Khoa TP.HCM", ["bách khoa tp hcm", "bach khoa tphcm", "hcmut", "bách khoa sài gòn", "bach khoa sai gon"]),
    ("hcmus", "Đại học Khoa học Tự nhiên TP.HCM", ["khtn", "khoa học tự nhiên", "khoa hoc tu nhien", "hcmus", "đại học khoa học tự nhiên"]),
    ("hou", "Đại học Mở TP.HCM", ["đại học mở", "dai hoc mo", "hou", "uni mở"]),
]
QUESTION_PHRASES = [
    "điểm chuẩn", "diem chuan", "học phí", "hoc phi", "chỉ tiêu", "chi tieu", "ngành học", "nganh hoc",
    "xét tuyển", "xet tuyen", "học bổng", "hoc bong", "ký túc", "ky tuc", "túc xá", "tuc xa",
]
SELECTION_FILLERS = [
    "truong", "trường", "dai", "đại", "hoc", "học", "mình", "minh", "toi", "tôi", "chon", "chọn",
    "la", "là", "muon", "muốn", "hoi", "hỏi", "ve", "về", "thong", "thông", "tin", "em",
]
SCORE_WORDS = ["điểm chuẩn", "diem chuan"]
OTHER_YEARS = ["các năm khác", "cac nam khac", "năm trước", "nam truoc", "năm khác", "nam khac", "cac nam truoc"]
SCORE_BOOST = " điểm trúng tuyển bảng điểm chuẩn"
YEARS_BOOST = " điểm trúng tuyển 2020 2021 2022 2023 2024 các năm trước"
SOFT_404 = ["không tìm thấy trang", "page not found", "lỗi 404", "error 404", "trang không tồn tại", "trang bạn tìm kiếm không tồn tại"]
FILE_TYPES = [".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx"]
IMAGE_TYPES = [".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp"]
VIDEO_TYPES = [".mp4", ".avi", ".mov", ".mkv", ".webm", ".m4v"]
AUDIO_TYPES = [".mp3", ".wav", ".ogg", ".m4a"]
ASSET_TYPES = [".js", ".css", ".map", ".ico", ".svg", ".woff", ".woff2", ".ttf", ".eot"]
SKIP_TYPES = [
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".zip", ".rar", ".jpg", ".jpeg", ".png", ".gif", ".svg",
    ".webp", ".ico", ".bmp", ".mp4", ".avi", ".mov", ".mkv", ".webm", ".mp3", ".wav", ".woff", ".woff2",
]
GREETINGS = ["xin chao", "hello", "hi", "chao", "hey", "alo", "helo", "hellu", "chao ban", "chao shop", "chao ad", "eii", "admin oi", "shop oi"]
CONFIRMS = [
    "co", "co a", "dung", "dung roi", "ok", "ok em", "yes", "vang", "vang a", "uh", "uhm", "muon", "dong y", "duoc", "oke",
    "okie", "oki", "okela", "dc", "uk", "ukm", "um", "chot", "trien", "duyet", "da", "da co", "da vang", "chinh xac", "chuan",
]
NONSENSE = [
    "asdf", "qwerty", "hjkl", "abc", "xyz", "fgh", "asd", "zxc", "haha", "hihi", "kaka", "hoho", "huhu", "hehe", "keke",
    "lol", "lmao", "bruh", "wtf", "omg", "dkm", "vl", "dm", "ahihi", "kakaka", "hahaha", "hihihi", "hehehehe", "test",
    "testing", "thu", "thu xem", "thu thoi", "hmm", "zzz", "...", "???", "!!!", "aaa", "bbb", "ccc", "ddd", "eee", "fff",
    "123", "1234", "blah", "blah blah", "giberish", "abc xyz", "nothing", "khong biet", "gi do", "dsadsa", "fdsf", "ghfgh",
    "jkljkl", "tyuty",
]
QUESTION_HINTS = ["nganh", "ngành", "diem", "điểm", "chi tieu", "hoc phi", "truong", "trường"]
QUOTA_ERRORS = ["quota", "429", "resource_exhausted", "rate_limit"]
KEY_ERRORS = ["permission", "403", "leaked", "api_key"]
ACCENTS = [
    ("a", "àáạảãâầấậẩẫăằắặẳẵ"),
    ("e", "èéẹẻẽêềếệểễ"),
    ("i", "ìíịỉĩ"),
    ("o", "òóọỏõôồốộổỗơờớợởỡ"),
    ("u", "ùúụủũưừứựửữ"),
    ("y", "ỳýỵỷỹ"),
    ("d", "đ"),
]
HIDDEN_ELEMENTS = ["script", "style", "nav", "header", "footer", "aside", "iframe", "noscript"]
CONTENT_CLASSES = ["entry-content", "post-content", "content-area", "article-body", "page-content"]
