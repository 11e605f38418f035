"""Numbers, names, word lists and patterns that results depend on."""

# --- Fixed values: ratings -------------------------------------------------
BASE_ELO = 1500.0
K_FACTOR = 30.0
HOME_ADVANTAGE = 65.0
ELO_DIVISOR = 400.0
ELO_MIN, ELO_MAX = 800.0, 2800.0

# Margin-of-victory rating variant
MOV_K = 24.0
MOV_REVERSION = 0.20
MOV_MIN, MOV_MAX = 800.0, 2400.0

# --- Fixed values: expected goals and outcome calibration ------------------
ELO_FACTOR_DENOM = 5000.0
BASE_GOAL_RATE = 1.11
MAX_GOALS = 8
HOME_BOOST = 1.15
GOAL_WEIGHT_ATTACK = 0.55
GOAL_WEIGHT_DEFENSE = 0.45
XG_MIN, XG_MAX = 0.3, 2.5
DRAW_ADJUSTMENT = 1.11
HOME_ADVANTAGE_BOOST = 0.02
MAX_PREDICTED_GOALS = 6
CONFIDENCE_STRONG = 0.55
CONFIDENCE_MODERATE = 0.48
BLEND_RATIO = 0.6

# --- Fixed values: shrinkage, score-grid variants --------------------------
SHRINKAGE_C = 5.0
LEAGUE_MEAN_XG = 1.15
DIAGONAL_RHO = 0.14
BIVARIATE_RHO = -0.06
MINIMAL_HOME_ADVANTAGE = 0.30

# --- Fixed values: windows -------------------------------------------------
TRAILING_WINDOW = 8
EWMA_HALFLIVES = (2, 4, 8)
ROLLING_WINDOWS = (5, 10)
VENUE_MIN_MATCHES = 3
SEGMENT_GAP_DAYS = 21
N_SPLITS = 5
DRAW_WEIGHT = 0.7

# --- Fixed values: result encoding -----------------------------------------
RESULT_CODES = {"H": 2, "D": 1, "A": 0}
RESULT_LABELS = {2: "Home Win", 1: "Draw", 0: "Away Win"}
REPORT_CODES = {"L": "H", "E": "D", "V": "A"}

# --- Fixed values: the 24 model features ------------------------------------
FEATURE_COLUMNS = [
    "Home_Elo", "Away_Elo", "Elo_Diff",
    "Home_Avg_GF", "Away_Avg_GF", "Home_Avg_GA", "Away_Avg_GA",
    "Home_Form", "Away_Form",
    "Attack_Balance", "Def_Balance", "Form_Balance",
    "xG_home", "xG_away", "xG_diff",
    "Poisson_Home_Win", "Poisson_Draw", "Poisson_Away_Win",
    "Expected_Home_Goals", "Expected_Away_Goals", "Expected_Total_Goals",
    "Shin_Prob_H", "Shin_Prob_D", "Shin_Prob_A",
]

# --- Fixed values: built-in club aliases (canonical spelling -> club) --------
CLUB_ALIASES = {
    "CENTRAL CORDOBA (SGO)": "CENTRAL CORDOBA",
    "CENTRAL CORDOBA SDE": "CENTRAL CORDOBA",
    "CENTRAL CBA": "CENTRAL CORDOBA",
    "ESTUDIANTES": "ESTUDIANTES LP",
    "ESTUDIANTES DE LA PLATA": "ESTUDIANTES LP",
    "ESTUDIANTES (LP)": "ESTUDIANTES LP",
    "GIMNASIA": "GIMNASIA LP",
    "GIMNASIA Y ESGRIMA": "GIMNASIA LP",
    "GIMNASIA (LP)": "GIMNASIA LP",
    "GIMNASIA DE LA PLATA": "GIMNASIA LP",
    "GIMNASIA MZA": "GIMNASIA MENDOZA",
    "GIMNASIA (M)": "GIMNASIA MENDOZA",
    "GIMNASIA Y ESGRIMA (M)": "GIMNASIA MENDOZA",
    "INSTITUTO ACC": "INSTITUTO",
    "INSTITUTO (C)": "INSTITUTO",
    "NEWELLS": "NEWELLS OLD BOYS",
    "NEWELLS OLD BOYS (ROS)": "NEWELLS OLD BOYS",
    "NOB": "NEWELLS OLD BOYS",
    "ROSARIO": "ROSARIO CENTRAL",
    "R CENTRAL": "ROSARIO CENTRAL",
    "TALLERES": "TALLERES CORDOBA",
    "TALLERES (C)": "TALLERES CORDOBA",
    "TALLERES DE CORDOBA": "TALLERES CORDOBA",
    "UNION": "UNION DE SANTA FE",
    "UNION SF": "UNION DE SANTA FE",
    "DEFENSA": "DEFENSA Y JUSTICIA",
    "DYJ": "DEFENSA Y JUSTICIA",
    "ATL": "ATL TUCUMAN",
    "ATL TUC": "ATL TUCUMAN",
    "TUCUMAN": "ATL TUCUMAN",
    "IND RIVADAVIA": "INDEPENDIENTE RIVADAVIA",
    "IND RIV": "INDEPENDIENTE RIVADAVIA",
    "DEP RIESTRA": "DEP RIESTRA",
    "RIESTRA": "DEP RIESTRA",
    "DEPORTIVO RIESTRA": "DEP RIESTRA",
    "BARRACAS": "BARRACAS CENTRAL",
    "SARMIENTO": "SARMIENTO JUNIN",
    "SARMIENTO (J)": "SARMIENTO JUNIN",
}

# --- Fixed values: feed club labels, tried in this order by containment ------
CLUB_LABELS = {
    "Boca Juniors": "BOCA JUNIORS",
    "River Plate": "RIVER PLATE",
    "Estudiantes de La Plata": "ESTUDIANTES LP",
    "Independiente Rivadavia": "IND RIVADAVIA",
    "Club Atlético Independiente": "INDEPENDIENTE",
    "San Lorenzo de Almagro": "SAN LORENZO",
    "Vélez Sarsfield": "VELEZ SARSFIELD",
    "Rosario Central": "ROSARIO CENTRAL",
    "Talleres de Córdoba": "TALLERES CORDOBA",
    "Banfield": "BANFIELD",
    "Lanús": "LANUS",
    "Argentinos Juniors": "ARGENTINOS JUNIORS",
    "Defensa y Justicia": "DEFENSA Y JUSTICIA",
    "Huracán": "HURACAN",
    "Tigre": "TIGRE",
    "Instituto": "INSTITUTO",
    "Central Córdoba": "CENTRAL CORDOBA",
    "Unión de Santa Fe": "UNION DE SANTA FE",
    "Platense": "PLATENSE",
    "Barracas Central": "BARRACAS CENTRAL",
    "Newell's Old Boys": "NEWELLS OLD BOYS",
    "Gimnasia y Esgrima": "GIMNASIA LP",
    "Deportivo Riestra": "DEP RIESTRA",
    "Belgrano": "BELGRANO",
    "Sarmiento": "SARMIENTO JUNIN",
    "Atlético Tucumán": "ATL TUCUMAN",
    "Aldosivi": "ALDOSIVI",
}

# --- Fixed values: header names (canonical header -> column) -----------------
HEADER_NAMES = {
    "DATE": "Date", "FECHA": "Date",
    "HOME": "Home", "HOMETEAM": "HomeTeam", "HOME TEAM": "HomeTeam", "LOCAL": "HomeTeam",
    "AWAY": "Away", "AWAYTEAM": "AwayTeam", "AWAY TEAM": "AwayTeam", "VISITANTE": "AwayTeam",
    "RES": "Res", "RESULT": "Res", "FTR": "Res", "FULLTIMERESULT": "FullTimeResult",
    "HG": "HG", "FTHG": "HG", "HOME GOALS": "HG",
    "AG": "AG", "FTAG": "AG", "AWAY GOALS": "AG",
    "B365CH": "B365CH", "B365CD": "B365CD", "B365CA": "B365CA",
    "XG": "xG", "XG HOME": "xG_home", "XG AWAY": "xG_away",
    "PPG": "PPG", "POSITION": "Position", "POS": "Position",
    "POINTS": "Points", "PTS": "Points",
}

# --- Fixed values: words and phrases in feeds --------------------------------
CHALLENGE_PHRASES = [
    "not a robot", "verify you are human", "recaptcha", "captcha",
    "challenge", "verify human", "verify yourself", "are you human",
]
SCORE_SKIP_WORDS = [
    "fecha", "hora", "estadio", "canal", "tv", "ver", "vivo", "fixture",
    "resultados", "tyc sports",
]
RESULT_SKIP_WORDS = ["cantidad", "total", "resumen", "fecha"]
RESULT_STOP_WORDS = ["cantidad de", "total", "pos", "participante"]
RESULT_HEADER = "resultados de la fecha"
ENTITY_COLUMNS = {
    "enhanced": ["Squad", "Team", "Equipo", "Club", "Nombre", "Name", "Squadra"],
    "manual": ["Squad", "Team", "Equipo", "Club", "Name", "Nombre"],
    "metrics": ["Team", "Squad", "Club", "Name", "Equipo"],
}
ADVANCED_STAT_MARKS = ["XG", "PPG", "GLS", "SH", "GA90"]

# --- Fixed values: squad-list patterns ---------------------------------------
SQUAD_STRUCTURED = (
    r"(GK|DF|MF|FW|Arquero|Defensor|Mediocampista|Delantero)"
    r"[\s\t]+([A-ZÁÉÍÓÚÑ][a-záéíóúñA-ZÁÉÍÓÚÑ\s\-'\.]{3,40})"
    r"[\s\t]+([A-Za-záéíóúñÁÉÍÓÚÑ\s\.\-'&]{3,50})"
)
SQUAD_INLINE = (
    r"([A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:\s[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+)+)"
    r"\s*\(([^)]{3,50})\)"
)
SQUAD_LABELS = {
    "structured": "structured (position + name + club)",
    "inline": "inline (name + club in parentheses)",
    "unmatched": "text present but pattern unmatched — manual review needed",
    "unreadable": "not machine-readable",
}
