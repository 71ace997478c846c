"""Threshold rules: value to level 1..5 and message, and the alert rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.functions.text import parse_num

INF = float("inf")


def _rule(kind, levels, messages=None, mapping=None):
    return {"type": kind, "levels": levels, "messages": messages, "mapping": mapping or {}}


def _lower(levels, *messages):
    return _rule("lower_better", levels, list(messages) or None)


def _higher(levels, *messages):
    return _rule("higher_better", levels, list(messages) or None)


def _category(mapping, *messages):
    return _rule("categorical", [], list(messages) or None, mapping)


# Cuts and messages of each indicator.
THRESHOLDS = {
    "gsd_cm": _lower(
        [15.0, 10.0, 7.0, 5.0, INF], "GSD critico", "GSD alto", "GSD aceitavel", "GSD bom", "GSD excelente"
    ),
    "motion_blur_risk": _lower(
        [1.5, 1.2, 0.7, 0.5, INF],
        "Motion blur critico",
        "Motion blur alto",
        "Motion blur moderado",
        "Motion blur baixo",
        "Motion blur minimo",
    ),
    "photogrammetry_quality_index": _higher(
        [45, 60, 75, 85, 95],
        "Qualidade critica",
        "Qualidade baixa",
        "Qualidade OK",
        "Qualidade boa",
        "Qualidade excelente",
    ),
    "orthorectification_potential": _higher(
        [35, 45, 55, 65, 72],
        "Potencial muito baixo",
        "Potencial baixo",
        "Potencial OK",
        "Potencial bom",
        "Potencial excelente",
    ),
    "rtk_std_lon": _lower(
        [0.05, 0.03, 0.02, 0.01, INF],
        "RTK lon critico",
        "RTK lon ruim",
        "RTK lon OK",
        "RTK lon bom",
        "RTK lon excelente",
    ),
    "rtk_std_lat": _lower([0.05, 0.03, 0.02, 0.01, INF]),
    "rtk_std_hgt": _lower(
        [0.1, 0.06, 0.04, 0.02, INF],
        "RTK hgt critico",
        "RTK hgt ruim",
        "RTK hgt OK",
        "RTK hgt bom",
        "RTK hgt excelente",
    ),
    "rtk_effective_precision": _lower(
        [0.1, 0.05, 0.02, 0.01, INF], "RTK Critica", "RTK Baixa", "RTK Média", "RTK Alta", "RTK Excelente"
    ),
    "shutter_life_pct": _lower(
        [60, 35, 20, 10, INF],
        "Desgaste muito alto",
        "Desgaste alto",
        "Desgaste moderado",
        "Desgaste baixo",
        "Desgaste minimo",
    ),
    "speed_3d_ms": _lower(
        [22.0, 18.0, 15.0, 8.0, INF],
        "Velocidade critica",
        "Velocidade alta",
        "Velocidade OK",
        "Velocidade boa",
        "Velocidade ideal",
    ),
    "incidence_angle": _rule(
        "range_best",
        [[0.0, 80.0], [80.0, 90.0], [90.0, 98.0], [98.0, 108.0], [108.0, 120.0]],
        ["Angulo critico", "Angulo abaixo do ideal", "Angulo OK", "Angulo bom", "Angulo excelente"],
    ),
    "sensor_temp_c": _lower(
        [48, 45, 43, 40, INF],
        "Temperatura critica",
        "Temperatura alta",
        "Temperatura moderada",
        "Temperatura baixa",
        "Temperatura ideal",
    ),
    "light_consistency": _category(
        {"Unknown": 1, "Fluorescent": 3, "Daylight": 5},
        "Iluminacao desconhecida",
        "Iluminacao ruim",
        "Iluminacao OK",
        "Iluminacao boa",
        "Iluminacao ideal",
    ),
    "predicted_overlap": _higher(
        [35, 60, 70, 75, 80],
        "Sobreposicao critica",
        "Sobreposicao baixa",
        "Sobreposicao OK",
        "Sobreposicao boa",
        "Sobreposicao excelente",
    ),
    "vertical_stability": _lower(
        [2.0, 0.8, 0.3, 0.1, INF],
        "Estabilidade vertical critica",
        "Estabilidade vertical baixa",
        "Estabilidade vertical OK",
        "Estabilidade vertical boa",
        "Estabilidade vertical excelente",
    ),
    "speed_variation_index": _lower(
        [0.8, 0.4, 0.2, 0.05, INF],
        "Variacao de velocidade critica",
        "Variacao de velocidade alta",
        "Variacao de velocidade OK",
        "Variacao de velocidade baixa",
        "Velocidade muito estavel",
    ),
    "gimbal_angular_velocity": _lower(
        [80, 40, 20, 5, INF],
        "Movimento angular critico",
        "Movimento angular alto",
        "Movimento angular moderado",
        "Movimento angular baixo",
        "Movimento angular minimo",
    ),
    "yaw_alignment_error": _lower(
        [30, 15, 10, 5, INF],
        "Yaw alignment error critico",
        "Yaw alignment error alto",
        "Yaw alignment error OK",
        "Yaw alignment error baixo",
        "Yaw alignment error minimo",
    ),
    "trajectory_smoothness": _lower(
        [100, 50, 20, 5, INF],
        "Trajetoria muito irregular",
        "Trajetoria irregular",
        "Trajetoria OK",
        "Trajetoria suave",
        "Trajetoria muito suave",
    ),
    "capture_efficiency": _higher(
        [0.05, 0.15, 0.3, 0.45, 0.55],
        "Eficiencia critica",
        "Eficiencia baixa",
        "Eficiencia OK",
        "Eficiencia boa",
        "Eficiencia excelente",
    ),
    "xy_difference": _lower(
        [0.1, 0.05, 0.02, 0.0, INF],
        "Diferenca XY critica",
        "Diferenca XY ruim",
        "Diferenca XY OK",
        "Diferenca XY boa",
        "Diferenca XY excelente",
    ),
    "z_difference": _lower(
        [0.1, 0.05, 0.02, 0.0, INF],
        "Diferenca Z critica",
        "Diferenca Z ruim",
        "Diferenca Z OK",
        "Diferenca Z boa",
        "Diferenca Z excelente",
    ),
    "is_valid_sequence_prev": _category(
        {"0": 1, "1": 5},
        "Sequencia previa invalida",
        "Sequencia previa ruim",
        "Sequencia previa OK",
        "Sequencia previa boa",
        "Sequencia previa valida",
    ),
    "is_valid_sequence_next": _category(
        {"0": 1, "1": 5},
        "Sequencia seguinte invalida",
        "Sequencia seguinte ruim",
        "Sequencia seguinte OK",
        "Sequencia seguinte boa",
        "Sequencia seguinte valida",
    ),
    "abrupt_change_flag": _lower(
        [3.0, 2.0, 1.5, 1.0, INF],
        "Mudanca critica",
        "Mudanca alta",
        "Mudanca moderada",
        "Mudanca baixa",
        "Sem mudanca abrupta",
    ),
    "rtk_diff_age": _lower(
        [5.0, 2.0, 1.0, 0.5, INF],
        "Idade do sinal RTK critica",
        "Idade do sinal RTK alta",
        "Idade do sinal RTK OK",
        "Idade do sinal RTK boa",
        "Idade do sinal RTK excelente",
    ),
    "rtk_stability_score": _higher(
        [90.0, 95.0, 98.0, 99.0, 99.9],
        "RTK estabilidade critica",
        "RTK estabilidade baixa",
        "RTK estabilidade OK",
        "RTK estabilidade boa",
        "RTK estabilidade excelente",
    ),
    "ev_classification": _category(
        {
            "noite/escuro": 1,
            "sol muito forte/neve": 2,
            "indoor/sombra": 3,
            "luz solar normal": 4,
            "nublado": 5,
        },
        "Exposicao muito baixa (noite/escuro)",
        "Exposicao extrema (sol muito forte/neve)",
        "Exposicao baixa (indoor/sombra)",
        "Exposicao boa (luz solar normal)",
        "Exposicao ideal (nublado)",
    ),
    "dewarp_flag": _category(
        {"0": 1},
        "Dewarp nao aplicado (critico)",
        "Dewarp ausente (indisponivel)",
        "Dewarp aplicado (aceitavel)",
        "Dewarp aplicado (bom)",
        "Dewarp aplicado (excelente)",
    ),
    "light_source_classification": _category(
        {"Unknown": 1, "Fluorescent": 3, "Daylight": 5},
        "Fonte de luz desconhecida",
        "Fonte de luz ruim",
        "Fonte de luz OK",
        "Fonte de luz boa",
        "Fonte de luz ideal",
    ),
    "rtk_type": _category(
        {"Sem GPS": 1, "RTK Desconhecido": 1, "RTK Single": 2, "RTK Float": 3, "RTK Fixed": 5},
        "Sem sinal GPS - posicao inviavel",
        "RTK Single - precisao baixa (~1-5 m)",
        "RTK Float - precisao media (~0,1-1 m)",
        "RTK Float - precisao media (~0,1-1 m)",
        "RTK Fixed - precisao excelente (~1-5 cm)",
    ),
}
# Fixed value: message of a level in a rule without messages.
NO_MESSAGE = "Nivel {{}}"

_SCHEMA = (
    "indicator string, type string, cuts array<double>, lows array<double>, highs array<double>, "
    "mapping map<string,int>, messages array<string>"
)


def rules_frame(spark: SparkSession, rules: dict = THRESHOLDS) -> DataFrame:
    """The rules as a table, one row per indicator."""
    rows = []
    for name, r in rules.items():
        ranged = r["type"] == "range_best"
        pairs = [lv if isinstance(lv, (list, tuple)) else [-INF, lv] for lv in r["levels"]] if ranged else []
        rows.append(
            (
                name,
                r["type"],
                [] if ranged else [float(v) for v in r["levels"]],
                [float(p[0]) for p in pairs],
                [float(p[1]) for p in pairs],
                {str(k): int(v) for k, v in r["mapping"].items()},
                list(r["messages"] or [NO_MESSAGE] * 5),
            )
        )
    return spark.createDataFrame(rows, _SCHEMA)


def _category_text(value: Column) -> Column:
    """Whole numbers lose their decimals so 0.0 meets the key "0"."""
    return F.regexp_replace(value.cast("string"), r"^(-?\d+)\.0+$", "$1")


def _level(kind: Column, number: Column, text: Column, cuts, lows, highs, mapping) -> Column:
    at_least = F.size(F.filter(cuts, lambda c: number >= c))
    at_most = F.size(F.filter(cuts, lambda c: number <= c))
    inside = F.array_position(
        F.zip_with(lows, highs, lambda lo, hi: F.coalesce((lo <= number) & (number <= hi), F.lit(False))),
        True,
    )
    ranked = (
        F.when(number.isNull(), 3)
        .when(kind == "higher_better", at_least)
        .when(kind == "lower_better", at_most)
        .when((kind == "range_best") & (inside > 0), inside.cast("int"))
        .otherwise(3)
    )
    category = F.coalesce(F.try_element_at(mapping, text), F.lit(3))
    return F.greatest(
        F.lit(1), F.least(F.lit(5), F.when(kind == "categorical", category).otherwise(ranked))
    )


def classify(
    long: DataFrame,
    rules: DataFrame | dict = THRESHOLDS,
    indicator: str = "indicator",
    value: str = "value",
    null_as_inf: bool = False,
) -> DataFrame:
    """Add ``level`` and ``message`` to an (indicator, value) table.

    Null values are left out unless ``null_as_inf``, which treats them as
    infinity.  An indicator without a rule gets level 3.
    """
    d = long if null_as_inf else long.filter(F.col(value).isNotNull())
    numeric_input = dict(long.dtypes)[value] in ("double", "float", "bigint", "int")
    number = F.col(value).cast("double") if numeric_input else parse_num(F.col(value))
    if null_as_inf:
        number = F.when(F.col(value).isNull(), INF).otherwise(number)
    d = d.withColumn("_num", number)
    number, text = F.col("_num"), F.col(value)
    if isinstance(rules, dict):
        # The rules are known here, so they become plain comparisons.
        level, labels, kind = F.lit(None).cast("int"), F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, rule in rules.items():
            mine = F.col(indicator) == name
            lvl = F.coalesce(level_of(rule, text if rule["type"] == "categorical" else number, True), F.lit(3))
            level = F.when(mine, lvl).otherwise(level)
            kind = F.when(mine, rule["type"]).otherwise(kind)
        d = d.withColumns({"_lvl": level, "type": kind})
        for name, rule in rules.items():
            labels = F.when(F.col(indicator) == name, message_of(rule, F.col("_lvl"))).otherwise(labels)
        d = d.withColumn("_msg", labels)
    else:
        table = rules.withColumnRenamed("indicator", "_ind")
        # A rule table has one row per indicator name.
        d = d.join(F.broadcast(table), F.col(indicator) == F.col("_ind"), "left")
        parts = [F.col(c) for c in ("cuts", "lows", "highs", "mapping")]
        d = d.withColumn("_lvl", _level(F.col("type"), number, _category_text(text), *parts))
        d = d.withColumn("_msg", F.try_element_at("messages", F.col("_lvl")))
    message = (
        F.when(F.col("type").isNull(), F.concat(F.lit("Indicator "), F.col(indicator), F.lit(" nao configurado (OK default)")))
        .when(
            (F.col("type") != "categorical") & number.isNull(),
            F.concat(F.lit("Valor invalido para "), F.col(indicator), F.lit(": "), text.cast("string")),
        )
        .otherwise(F.col("_msg"))
    )
    return d.select(
        *long.columns,
        F.when(F.col("type").isNull(), 3).otherwise(F.col("_lvl")).alias("level"),
        message.alias("message"),
    )


def level_of(rule: dict, value: Column, typed: bool = False) -> Column:
    """Level of one indicator as a plain expression; null stays null.

    ``typed`` says the value is a number already and needs no parsing.
    """
    kind = rule["type"]
    if kind == "categorical":
        text = _category_text(value)
        out = F.lit(3)
        for k, v in rule["mapping"].items():
            out = F.when(text == str(k), v).otherwise(out)
        return F.when(value.isNotNull(), out)
    number = value if typed else parse_num(value)
    if kind == "range_best":
        out = F.lit(3)
        for i, lv in reversed(list(enumerate(rule["levels"], 1))):
            lo, hi = lv if isinstance(lv, (list, tuple)) else (-INF, lv)
            out = F.when(number.between(float(lo), float(hi)), i).otherwise(out)
    else:
        hits = F.lit(0)
        for cut in rule["levels"]:
            met = number >= float(cut) if kind == "higher_better" else number <= float(cut)
            hits = hits + F.when(met, 1).otherwise(0)
        out = F.when(number.isNull(), 3).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), hits)))
    return F.when(value.isNotNull(), out)


def message_of(rule: dict, level: Column) -> Column:
    texts = list(rule["messages"] or [NO_MESSAGE] * 5)
    return F.try_element_at(F.array(*[F.lit(t) for t in texts]), level)


def _when(severity, kind, **values):
    return {"severity": severity, "type": kind, **values}


# Alert rules.
ALERTS = {
    "dewarp_disabled": {
        "mode": "aggregate_field",
        "category": "DEWARP",
        "aggregate_field": "dewarp_zero_count",
        "condition": ("gt", 0),
        "severity": "CRITICO",
        "photos_zero": "DewarpFlag",
        "title": "Dewarp desativado em {affected_count} foto(s) - CRITICO",
        "impact": "Distorcao sistematica compromete aerotriangulacao, geometria e qualidade radiometrica da reconstrucao.",
        "action": "Reprocessar 100% das imagens com dewarping habilitado e validar calibracao interna da camera.",
    },
    "altitude_missing": {
        "mode": "aggregate_field",
        "category": "ALTITUDE",
        "aggregate_field": "missing_altitude_count",
        "condition": ("gt", 0),
        "rules": [
            _when("CRITICO", "pct_gt", value=50.0),
            _when("ALERTA", "pct_gt", value=10.0),
            _when("INFO", "pct_gt", value=0.0),
        ],
        "title": "{affected_count} foto(s) sem altitude completa",
        "impact": "Afeta consistencia altimetrica, calculo de GSD e sobreposicao prevista.",
        "action": "Corrigir captura de Alt (MRK) e AbsoluteAltitude antes do processamento.",
    },
    "motion_blur_risk": {
        "mode": "threshold_levels",
        "category": "MOTION_BLUR",
        "indicator": "motion_blur_risk",
        "rules": [_when("CRITICO", "any_at_level", level=1), _when("ALERTA", "any_at_level", level=2)],
        "title": "Motion Blur elevado em {affected_count} foto(s)",
        "impact": "Borramento reduz nitidez das imagens, compromete matching, DSM e ortofoto.",
        "action": "Reduzir velocidade de voo, ajustar taxa de obturação e evitar vento forte.",
        "max_photos": 20,
    },
    "gimbal_offset": {
        "mode": "threshold_levels",
        "category": "GIMBAL",
        "indicator": "gimbal_angular_velocity",
        "rules": [_when("CRITICO", "any_at_level", level=1), _when("ALERTA", "any_at_level", level=2)],
        "title": "Gimbal desalinhado em {affected_count} foto(s)",
        "impact": "Desalinhamento do gimbal causa rotacao na imagem, afetando matching e orientacao.",
        "action": "Recalibrar gimbal, verificar fixacao e realizar voo de calibracao.",
        "max_photos": 20,
    },
    "rtk_flag_quality": {
        "mode": "rtk_flag",
        "category": "RTK_FLAG",
        "flags": (50, 34, 16),
        "rules": [
            _when("CRITICO", "fixed_pct_lt", value=80.0),
            _when("ALERTA", "non_fixed_pct_gt", value=5.0),
            _when("INFO", "non_fixed_count_gt", value=0),
        ],
        "title": "Queda na qualidade do sinal RTK detectada",
        "impact": "Sinal RTK nao-fixo reduz precisao posicional e pode degradar o georreferenciamento direto.",
        "action": "Verificar base RTK, radio link, visibilidade GNSS e configuracao do receptor.",
        "max_photos": 20,
    },
    "gsd_variation": {
        "mode": "aggregate_std",
        "category": "GSD_VARIATION",
        "indicator": "gsd_cm",
        "std_threshold": 0.5,
        "severity": "ALERTA",
        "title": "Variacao de GSD acima do limiar em {affected_count} voo(s)",
        "impact": "Variacao de GSD indica irregularidade de altitude que compromete a consistencia do produto final.",
        "action": "Verificar estabilidade de altitude do drone e condicoes de vento durante o voo.",
    },
    "predicted_overlap": {
        "mode": "threshold_levels",
        "category": "OVERLAP",
        "indicator": "predicted_overlap",
        "rules": [
            _when("CRITICO", "pct_at_level_or_worse", level=1, min_pct=65.0),
            _when("ALERTA", "pct_at_level_or_worse", level=2, min_pct=35.0),
        ],
        "title": "Overlap insuficiente para reconstrucao robusta",
        "impact": "Pode causar lacunas, alinhamento fraco e aumento de ruido no modelo 3D.",
        "action": "Aumentar sobreposicao longitudinal/lateral e refazer as faixas criticas.",
    },
    "yaw_alignment_error": {
        "mode": "threshold_levels",
        "category": "YAW",
        "indicator": "yaw_alignment_error",
        "rules": [_when("ALERTA", "pct_at_level_or_worse", level=1, min_pct=5.0)],
        "title": "Inconsistencia de direcao de voo (yaw)",
        "impact": "Direcoes conflitantes podem reduzir matching e gerar faixas desalinhadas.",
        "action": "Revisar planejamento de heading e evitar trechos em sentido oposto sem controle de bloco.",
    },
    "rtk_std_quality": {
        "mode": "threshold_levels_multi",
        "category": "RTK",
        "indicators": ["rtk_std_lat", "rtk_std_lon", "rtk_std_hgt"],
        "rules": [
            _when("CRITICO", "any_indicator_pct_at_level", level=1, min_pct=50.0),
            _when("ALERTA", "any_indicator_pct_at_level", level=1, min_pct=20.0),
        ],
        "title": "Sinal GPS/RTK com qualidade insuficiente",
        "impact": "Reduz precisao posicional e pode degradar alinhamento, georreferenciamento e qualidade final do produto.",
        "action": "Validar base RTK, radio/link, visibilidade GNSS e repetir trechos com altos desvios padrao.",
    },
    "rtk_effective_precision": {
        "mode": "threshold_levels",
        "category": "RTK",
        "indicator": "rtk_effective_precision",
        "rules": [_when("CRITICO", "any_at_level", level=1), _when("ALERTA", "any_at_level", level=2)],
        "title": "Precisao efetiva do RTK degradada",
        "impact": "Precisao RTK efetiva alta indica perda de qualidade posicional que compromete o georreferenciamento.",
        "action": "Verificar base RTK, qualidade do link de correcao e condicoes de visibilidade GNSS.",
        "max_photos": 20,
    },
    "xy_difference_info": {
        "mode": "threshold_levels",
        "category": "GENERAL",
        "indicator": "xy_difference",
        "rules": [_when("INFO", "any_at_level", level=4)],
        "title": "Diferença XY (MRK x Metadado) detectada em {affected_count} foto(s)",
        "impact": "Indica pequenas discrepancias entre as coordenadas do arquivo MRK e os metadados das imagens.",
        "action": "Monitorar calibracao do sistema GNSS e verificar consistencia entre importacao MRK e dados EXIF/XMP.",
    },
    "xy_difference_alert": {
        "mode": "threshold_levels",
        "category": "GENERAL",
        "indicator": "xy_difference",
        "rules": [_when("ALERTA", "any_at_level", level=2), _when("ALERTA", "any_at_level", level=1)],
        "title": "Diferença XY (MRK x Metadado) elevada em {affected_count} foto(s)",
        "impact": "Discrepancia planimetrica significativa pode indicar erro de georreferenciamento entre MRK e metadados EXIF/XMP.",
        "action": "Revisar arquivo MRK, verificar datum e sistema de coordenadas, recalcular se necessario.",
        "max_photos": 20,
    },
    "z_difference_info": {
        "mode": "threshold_levels",
        "category": "GENERAL",
        "indicator": "z_difference",
        "rules": [_when("INFO", "any_at_level", level=4)],
        "title": "Diferença Z (MRK x Metadado) detectada em {affected_count} foto(s)",
        "impact": "Pequenas variacoes verticais entre a cota do MRK e a altitude absoluta dos metadados.",
        "action": "Verificar consistencia altimetrica entre MRK e AbsoluteAltitude no metadado.",
    },
    "z_difference_alert": {
        "mode": "threshold_levels",
        "category": "GENERAL",
        "indicator": "z_difference",
        "rules": [_when("ALERTA", "any_at_level", level=2), _when("ALERTA", "any_at_level", level=1)],
        "title": "Diferença Z (MRK x Metadado) elevada em {affected_count} foto(s)",
        "impact": "Discrepancia altimetrica significativa compromete a consistencia vertical do produto final.",
        "action": "Verificar datum vertical, calibrar altimetro e revisar AbsoluteAltitude no metadado da imagem.",
        "max_photos": 20,
    },
    "sensor_temperature": {
        "mode": "threshold_levels",
        "category": "TEMPERATURE",
        "indicator": "sensor_temp_c",
        "rules": [_when("CRITICO", "any_at_level", level=1), _when("ALERTA", "any_at_level", level=2)],
        "title": "Temperatura do sensor elevada em {affected_count} foto(s)",
        "impact": "Temperatura elevada aumenta ruido termico, degrada qualidade radiometrica e pode causar artefatos.",
        "action": "Pausar voo para resfriamento, reduzir taxa de captura ou operar em horarios mais amenos.",
    },
    "speed_alert": {
        "mode": "threshold_levels",
        "category": "SPEED",
        "indicator": "speed_3d_ms",
        "rules": [_when("CRITICO", "any_at_level", level=1), _when("ALERTA", "any_at_level", level=2)],
        "title": "Velocidade de voo excessiva em {affected_count} foto(s)",
        "impact": "Velocidade alta aumenta motion blur e rolling shutter, comprometendo nitidez e matching.",
        "action": "Reduzir velocidade de voo para 8-15 m/s e ajustar taxa de obturação.",
    },
    "exposure_alert": {
        "mode": "threshold_levels",
        "category": "ILLUMINATION",
        "indicator": "ev_classification",
        "rules": [
            _when("CRITICO", "any_at_level", level=1),
            _when("ALERTA", "any_at_level", level=2),
            _when("INFO", "any_at_level", level=3),
        ],
        "title": "Condicao de luz inadequada em {affected_count} foto(s)",
        "impact": "Iluminacao inadequada prejudica extracao de tie points, qualidade radiometrica e consistencia da ortofoto.",
        "action": "Planejar voos em horarios com luz difusa (nublado/amanhecer) e evitar Sol forte ou periodo noturno.",
    },
    "rtk_type_alert": {
        "mode": "threshold_levels",
        "category": "RTK_FLAG",
        "indicator": "rtk_type",
        "rules": [
            _when("CRITICO", "any_at_level", level=1),
            _when("ALERTA", "any_at_level", level=2),
            _when("INFO", "any_at_level", level=3),
        ],
        "title": "Qualidade do sinal RTK comprometida em {affected_count} foto(s)",
        "impact": "Sinal RTK nao-fixo compromete a precisao posicional e pode degradar o georreferenciamento direto.",
        "action": "Verificar base RTK, radio link, visibilidade GNSS e condicoes de voo.",
    },
}
SEVERITY_ORDER = {"CRITICO": 0, "ALERTA": 1, "INFO": 2}
