"""Reference data: fixed values, and the small tables made from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Upgrade stages 0..29: success rate, destruction rate, divisor of the cost formula.
STAR_SUCCESS = [
    0.95, 0.90, 0.85, 0.85, 0.80, 0.75, 0.70, 0.65, 0.60, 0.55,
    0.50, 0.45, 0.40, 0.35, 0.30, 0.30, 0.30, 0.15, 0.15, 0.15,
    0.30, 0.15, 0.15, 0.10, 0.10, 0.10, 0.07, 0.05, 0.03, 0.01,
]
STAR_DESTROY = [0.0] * 15 + [
    0.021, 0.021, 0.068, 0.068, 0.085, 0.105, 0.1275, 0.17, 0.18, 0.18, 0.18, 0.186, 0.19, 0.194, 0.198,
]
STAR_DIVISOR = [36] * 10 + [571, 314, 214, 157, 107, 200, 200, 150, 70, 45, 200, 125] + [200] * 8
MAX_STAR = 30
RESET_STAR = 12
# Highest star by item level (level up to, stars); 30 above.
STAR_LIMITS = [(94, 5), (107, 8), (117, 10), (127, 15), (137, 20)]

# The other upgrade chain: success rates of stages 0..14, price of a failure.
NOLJANG_SUCCESS = [0.60, 0.55, 0.50, 0.40, 0.30, 0.20, 0.19, 0.18, 0.17, 0.16, 0.16, 0.14, 0.12, 0.10, 0.10]
NOLJANG_FAIL_COST = 9400 * 16000

# Price of one cube by type, level floor and grade (rare, epic, unique, legendary).
CUBE_COST = {
    "BLACK": {
        0: (4000000, 16000000, 34000000, 40000000),
        160: (4250000, 17000000, 36125000, 42500000),
        200: (4500000, 18000000, 38250000, 45000000),
        250: (5000000, 20000000, 42500000, 50000000),
    },
    "ADDITIONAL": {
        0: (13000000, 36400000, 44200000, 52000000),
        160: (13812500, 38675000, 46962500, 55250000),
        200: (14625000, 40950000, 49725000, 58500000),
        250: (16250000, 45500000, 55250000, 65000000),
    },
    "RED": {0: (1, 1, 1, 1)},
}
GRADE_NAMES = ("RARE", "EPIC", "UNIQUE", "LEGENDARY")

# Chance of each bonus stage by flame, for boss and other equipment.
FLAME_STAGES = {
    ("POWERFUL", True): {3: 0.20, 4: 0.30, 5: 0.36, 6: 0.14},
    ("ETERNAL", True): {4: 0.29, 5: 0.45, 6: 0.25, 7: 0.01},
    ("ABYSS", True): {5: 0.63, 6: 0.34, 7: 0.03},
    ("POWERFUL", False): {1: 0.20, 2: 0.30, 3: 0.36, 4: 0.14},
    ("ETERNAL", False): {2: 0.29, 3: 0.45, 4: 0.25, 5: 0.01},
    ("ABYSS", False): {3: 0.63, 4: 0.34, 5: 0.03},
}
# Bonus options of weapons; armour has SPEED and JUMP as well.
PAIRS = ("STR_DEX", "STR_INT", "STR_LUK", "DEX_INT", "DEX_LUK", "INT_LUK")
SINGLES = ("STR", "DEX", "INT", "LUK")
WEAPON_OPTIONS = (*SINGLES, *PAIRS, "MAX_HP", "MAX_MP", "LEVEL_REDUCE", "DEF", "ATT", "MAG", "BOSS_DMG_PCT", "DMG_PCT", "ALLSTAT_PCT")
ARMOUR_OPTIONS = (*WEAPON_OPTIONS, "SPEED", "JUMP")
FLAME_BUCKETS = (100, 110, 120, 130, 140, 150, 160, 170, 180, 200, 250)
# Value of one stage by level bucket where stages are linear: single stat and defence, pair, HP.
FLAME_LINEAR = {
    100: (6, 3, 300), 110: (6, 3, 330), 120: (7, 4, 360), 130: (7, 4, 390), 140: (8, 4, 420), 150: (8, 4, 450),
    200: (11, 6, 600), 250: (12, 7, 700),
}
BOSS_DAMAGE_STAGES = (2, 4, 6, 8, 10, 6, 7)
BOSS_DAMAGE_STAGES_200 = (2, 4, 6, 8, 10, 12, 14)
# Bucket 160 has stages 3..7 only: value of one stage of each kind (pairs and levels per stage, HP per stage).
FLAME_160 = {"single": 9, "pair": 5, "hp": 480, "one": 1, "level": 5}
# Buckets 170 and 180 have stages 1..5 only, and attack values of their own.
FLAME_170_180 = {170: (9, 5, 510, (9, 20, 32, 47, 64)), 180: (10, 5, 540, (11, 23, 38, 56, 76))}

# Classes by main and sub stats; all others are STR with DEX.
JOBS = {
    ("DEX", "STR"): ("보우마스터", "신궁", "패스파인더", "윈드브레이커", "와일드헌터", "카인", "메르세데스", "캡틴", "메카닉", "엔젤릭버스터"),
    ("INT", "LUK"): ("아크메이지(불,독)", "아크메이지(썬,콜)", "비숍", "플레임위자드", "에반", "루미너스", "키네시스", "일리움", "라라", "이벤져", "리엔"),
    ("LUK", "DEX"): ("나이트로드", "나이트워커", "팬텀", "칼리", "호영"),
    ("LUK", "STR", "DEX"): ("섀도어", "듀얼블레이드", "카데나"),
}
WEIGHTS = ("STR", "DEX", "INT", "LUK", "MAX_HP", "MAX_MP", "ALLSTAT_PCT", "ATT", "MAG", "DMG_PCT", "BOSS_DMG_PCT")
SCALE = 10
# Weights of the two classes that follow no main stat rule.
SPECIAL_JOBS = {
    "제논": (10, 10, 0, 10, 0, 0, 100, 40, 40, 140, 140),
    "데몬어벤져": (0, 0, 0, 0, 10, 0, 0, 1500, 0, 0, 0),
}
# Name prefixes of boss weapons and armour, and names of boss accessories.
BOSS_WEAPONS = ("자쿰의 포이즈닉", "네크로", "로얄 반 레온", "라이온하트", "드래곤테일", "팔콘윙", "레이븐혼", "샤크투스", "파프니르", "앱솔랩스", "아케인셰이드", "제네시스", "데스티니")
BOSS_ARMOUR = ("네크로", "로얄 반 레온", "라이온하트", "드래곤테일", "팔콘윙", "레이븐혼", "샤크투스", "이글아이", "트릭스터", "하이네스", "앱솔랩스", "아케인셰이드", "에테르넬")
BOSS_ACCESSORIES = (
    "아쿠아틱 레터 눈장식", "블랙빈 마크", "파풀라투스 마크", "응축된 힘의 결정석", "골든 클로버 벨트", "분노한 자쿰의 벨트",
    "매커네이터 펜던트", "도미네이터 펜던트", "데아 시두스 이어링", "지옥의 불꽃", "핑크빛 성배", "트와일라이트 마크", "에스텔라 이어링",
    "데이브레이크 펜던트", "루즈 컨트롤 머신 마크", "마력이 깃든 안대", "몽환의 벨트", "고통의 근원", "커맨더 포스 이어링",
    "저주받은 적의 마도서", "죽음의 맹세", "불멸의 유산", "오만의 원죄",
)


def job_weights(main: str, *subs: str) -> tuple[int, ...]:
    """Weights of a class: 10 for its main stat, 1 for sub stats, the usual rest."""
    stats = {s: 0 for s in SINGLES} | {s: 1 for s in subs} | {main: SCALE}
    return (*(stats[s] for s in SINGLES), 0, 0, 10 * SCALE, 4 * SCALE, 4 * SCALE, 14 * SCALE, 14 * SCALE)


def flame_values(bucket: int) -> dict[str, tuple[int | None, ...]]:
    """Value of each bonus option at stages 1..7 of a level bucket; None where there is no such stage."""

    def line(step: int, first: int = 1, last: int = 7) -> tuple[int | None, ...]:
        return tuple(step * s if first <= s <= last else None for s in range(1, 8))

    if bucket in FLAME_LINEAR:
        single, pair, hp = FLAME_LINEAR[bucket]
        table = {o: line(single) for o in (*SINGLES, "DEF")} | {o: line(pair) for o in PAIRS}
        table |= {"MAX_HP": line(hp), "MAX_MP": line(hp), "LEVEL_REDUCE": line(5)}
        table |= {o: line(1) for o in ("ATT", "MAG", "ALLSTAT_PCT", "DMG_PCT", "SPEED", "JUMP")}
        return table | {"BOSS_DMG_PCT": BOSS_DAMAGE_STAGES_200 if bucket == 200 else BOSS_DAMAGE_STAGES}
    if bucket == 160:
        steps = FLAME_160
        table = {o: line(steps["single"], 3) for o in (*SINGLES, "DEF")} | {o: line(steps["pair"], 3) for o in PAIRS}
        table |= {"MAX_HP": line(steps["hp"], 3), "MAX_MP": line(steps["hp"], 3), "LEVEL_REDUCE": line(steps["level"], 3)}
        return table | {o: line(steps["one"], 3) for o in ("ATT", "MAG", "ALLSTAT_PCT", "SPEED", "JUMP")}
    single, pair, hp, attack = FLAME_170_180[bucket]
    table = {o: line(single, 1, 5) for o in (*SINGLES, "DEF")} | {o: line(pair, 1, 5) for o in PAIRS}
    table |= {"MAX_HP": line(hp, 1, 5), "MAX_MP": line(hp, 1, 5), "LEVEL_REDUCE": line(5, 1, 5)}
    table |= {o: (*attack, None, None) for o in ("ATT", "MAG")} | {"BOSS_DMG_PCT": line(2, 1, 5)}
    return table | {o: line(1, 1, 5) for o in ("ALLSTAT_PCT", "DMG_PCT", "SPEED", "JUMP")}


def star_table(spark: SparkSession) -> DataFrame:
    rows = [(s, STAR_SUCCESS[s], STAR_DESTROY[s], STAR_DIVISOR[s]) for s in range(MAX_STAR)]
    return spark.createDataFrame(rows, "star int, success double, destroy double, divisor int")


def cube_cost_table(spark: SparkSession) -> DataFrame:
    """cube_type, grade, cost for levels in [lo, hi); the first range takes all lower levels."""
    rows = []
    for kind, tiers in CUBE_COST.items():
        floors = sorted(tiers)
        for i, floor in enumerate(floors):
            hi = floors[i + 1] if i + 1 < len(floors) else (1 << 31) - 1
            lo = -(1 << 31) if i == 0 else floor
            rows += [(kind, g, lo, hi, c) for g, c in zip(GRADE_NAMES, tiers[floor], strict=True)]
    return spark.createDataFrame(rows, "cube_type string, grade string, lo int, hi int, cost long")


def flame_value_table(spark: SparkSession) -> DataFrame:
    rows = [(b, o, s, v) for b in FLAME_BUCKETS for o, values in flame_values(b).items() for s, v in enumerate(values, 1)]
    return spark.createDataFrame(rows, "bucket int, option string, stage int, value int")


def flame_stage_table(spark: SparkSession) -> DataFrame:
    rows = [(f, b, s, p) for (f, b), stages in FLAME_STAGES.items() for s, p in stages.items()]
    return spark.createDataFrame(rows, "flame_type string, boss boolean, stage int, prob double")


def flame_option_table(spark: SparkSession) -> DataFrame:
    rows = [(w, i, o) for w, pool in ((True, WEAPON_OPTIONS), (False, ARMOUR_OPTIONS)) for i, o in enumerate(pool)]
    return spark.createDataFrame(rows, "weapon boolean, position int, option string")


def job_weight_table(spark: SparkSession) -> DataFrame:
    rows = [(job, *job_weights(*stats)) for stats, jobs in JOBS.items() for job in jobs]
    rows += [(job, *weights) for job, weights in SPECIAL_JOBS.items()]
    return spark.createDataFrame(rows, "job string, " + ", ".join(f"w_{w.lower()} int" for w in WEIGHTS))
