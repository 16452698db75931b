"""Fixed values of the data formats and rules. They must not change: results depend on them."""

# NSL-KDD columns in file order (41 features, class, difficulty).
NSL_KDD_COLUMNS = [
    ("duration", "bigint"),
    ("protocol_type", "string"),
    ("service", "string"),
    ("flag", "string"),
    ("src_bytes", "bigint"),
    ("dst_bytes", "bigint"),
    ("land", "int"),
    ("wrong_fragment", "int"),
    ("urgent", "int"),
    ("hot", "int"),
    ("num_failed_logins", "int"),
    ("logged_in", "int"),
    ("num_compromised", "int"),
    ("root_shell", "int"),
    ("su_attempted", "int"),
    ("num_root", "int"),
    ("num_file_creations", "int"),
    ("num_shells", "int"),
    ("num_access_files", "int"),
    ("num_outbound_cmds", "int"),
    ("is_host_login", "int"),
    ("is_guest_login", "int"),
    ("count", "int"),
    ("srv_count", "int"),
    ("serror_rate", "double"),
    ("srv_serror_rate", "double"),
    ("rerror_rate", "double"),
    ("srv_rerror_rate", "double"),
    ("same_srv_rate", "double"),
    ("diff_srv_rate", "double"),
    ("srv_diff_host_rate", "double"),
    ("dst_host_count", "int"),
    ("dst_host_srv_count", "int"),
    ("dst_host_same_srv_rate", "double"),
    ("dst_host_diff_srv_rate", "double"),
    ("dst_host_same_src_port_rate", "double"),
    ("dst_host_srv_diff_host_rate", "double"),
    ("dst_host_serror_rate", "double"),
    ("dst_host_srv_serror_rate", "double"),
    ("dst_host_rerror_rate", "double"),
    ("dst_host_srv_rerror_rate", "double"),
    ("attack_type", "string"),
    ("difficulty", "int"),
]

# The numeric columns the traffic model uses: everything but the three
# categorical columns, the class and the difficulty.
TRAFFIC_FEATURES = [
    name
    for name, _ in NSL_KDD_COLUMNS
    if name not in ("protocol_type", "service", "flag", "attack_type", "difficulty")
]

# Names the flow export gives to the first six features.
FLOW_EXPORT_HEAD = [
    "duration",
    "bytes_sent_src_to_dst",
    "bytes_sent_dst_to_src",
    "land",
    "wrong_fragments",
    "urgent_packets",
]
FLOW_EXPORT_COLUMNS = FLOW_EXPORT_HEAD + TRAFFIC_FEATURES[6:]

# Flow features that are not measured and carry a constant; the rest is 0.
FLOW_CONSTANT_ONES = ("hot", "count", "srv_count")

# Label columns of the intrusion datasets, in order of preference.
LABEL_NAMES = ["label", "class", "target", "attack", "y"]
CIC_LABEL_NAMES = ["Label", "label", " Label", "Attack"]
UNSW_LABEL_NAMES = ["attack_cat", "Label", "label", "Attack"]

# A column whose name contains one of these is not a feature.
NON_FEATURE_PARTS = [
    "flow id",
    "timestamp",
    "time",
    "date",
    "src ip",
    "dst ip",
    "source ip",
    "destination ip",
    "srcip",
    "dstip",
    "stime",
    "ltime",
    "starttime",
    "endtime",
]

# Cells that count as invalid.
PLACEHOLDERS = ["?", "-", "", "nan", "NaN"]

# CSV cells that pandas.read_csv reads as null (public pandas default).
CSV_NULL_TOKENS = [
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
]

# Severities of attack types; "normal" is low, unlisted types are high.
CRITICAL_ATTACKS = ["neptune", "smurf", "back", "teardrop", "pod", "land", "apache2", "udpstorm"]
MEDIUM_ATTACKS = ["ipsweep", "portsweep", "satan", "probe"]
NORMAL_ATTACK = "normal"

# Confidence written to the log for attacks and normal connections.
ATTACK_CONFIDENCE = 0.98
NORMAL_CONFIDENCE = 0.85

# Ensemble of the two malware scorers.
RF_WEIGHT = 0.7
NET_WEIGHT = 0.3
SERVING_THRESHOLD = 0.98
EVALUATION_THRESHOLD = 0.5

# File scan rules.
ALLOWED_EXTENSIONS = ["exe", "dll", "sys", "bin", "dat"]
MAX_FILE_MB = 16
SCAN_PREFIX_BYTES = 1024 * 1024
RETENTION_HOURS = 24
EICAR_NAME = "eicar.exe"
EICAR_HASH = "EICAR_TEST_FILE"
EICAR_LOG_CONFIDENCE = 0.98
KNOWN_BENIGN_NAMES = ["hello.exe", "pip3.11.exe", "pip3.exe"]
KNOWN_BENIGN_PROBABILITY = 0.6362
KNOWN_BENIGN_CONFIDENCE = 0.8186
UNSUPPORTED_WARNING = (
    "Unsupported file format for this model. Only PE files (exe/dll/sys) are supported."
)
API_TOKENS = [
    "GetProcAddress",
    "WriteFile",
    "ReadFile",
    "CreateFile",
    "VirtualAlloc",
    "VirtualProtect",
    "LoadLibrary",
    "GetModuleHandle",
]
MIN_TOKEN_LENGTH = 4
COMMON_DLLS = ["kernel32.dll", "user32.dll", "advapi32.dll", "ws2_32.dll"]

# PE header layout (public PE/COFF format): name, offset, bytes.
# Offsets count from the COFF header and from the optional header.
COFF_FIELDS = [
    ("Machine", 0, 2),
    ("SizeOfOptionalHeader", 16, 2),
    ("Characteristics", 18, 2),
]
COFF_SECTION_COUNT = ("SectionsNb", 2, 2)
# name, PE32 offset, PE32 bytes, PE32+ offset, PE32+ bytes
OPTIONAL_FIELDS = [
    ("MajorLinkerVersion", 2, 1, 2, 1),
    ("MinorLinkerVersion", 3, 1, 3, 1),
    ("SizeOfCode", 4, 4, 4, 4),
    ("SizeOfInitializedData", 8, 4, 8, 4),
    ("SizeOfUninitializedData", 12, 4, 12, 4),
    ("AddressOfEntryPoint", 16, 4, 16, 4),
    ("BaseOfCode", 20, 4, 20, 4),
    ("ImageBase", 28, 4, 24, 8),
    ("SectionAlignment", 32, 4, 32, 4),
    ("FileAlignment", 36, 4, 36, 4),
    ("MajorOperatingSystemVersion", 40, 2, 40, 2),
    ("MinorOperatingSystemVersion", 42, 2, 42, 2),
    ("MajorSubsystemVersion", 48, 2, 48, 2),
    ("MinorSubsystemVersion", 50, 2, 50, 2),
    ("SizeOfImage", 56, 4, 56, 4),
    ("SizeOfHeaders", 60, 4, 60, 4),
    ("Subsystem", 68, 2, 68, 2),
    ("DllCharacteristics", 70, 2, 70, 2),
    ("SizeOfStackReserve", 72, 4, 72, 8),
    ("SizeOfStackCommit", 76, 4, 80, 8),
    ("SizeOfHeapReserve", 80, 4, 88, 8),
    ("SizeOfHeapCommit", 84, 4, 96, 8),
    ("LoaderFlags", 88, 4, 104, 4),
    ("NumberOfRvaAndSizes", 92, 4, 108, 4),
]
PE32_MAGIC = 0x10B
PE32_PLUS_MAGIC = 0x20B
DATA_DIRECTORY_OFFSET = (96, 112)
RESOURCE_DIRECTORY_INDEX = 2
SECTION_HEADER_BYTES = 40
PE_FEATURES = [f[0] for f in COFF_FIELDS] + [f[0] for f in OPTIONAL_FIELDS] + ["SectionsNb"]

# Summaries the preprocessing overview expects.
EXPECTED_SUMMARIES = [
    "malware_summary",
    "dataset_test_summary",
    "cicids_summary",
    "nslkdd_summary",
    "unsw_summary",
]
PCA_VARIANCE_TARGET = 0.95
PACKET_BATCH = 1000
