"""Column lists of the published files the readers accept.

Every column arrives as text. The lists state the file formats, in file order. Those of
the inclusion files name the measures only.
"""

from __future__ import annotations


def _words(text: str) -> list[str]:
    return text.split()


REGISTRY = _words(
    """CLEE Id Nombre Razon_social Clase_actividad Estrato Tipo_vialidad Calle Num_Exterior Num_Interior Colonia CP
    Ubicacion Telefono Correo_e Sitio_internet Tipo Longitud Latitud tipo_corredor_industrial nom_corredor_industrial
    numero_local AGEB Manzana CLASE_ACTIVIDAD_ID SECTOR_ACTIVIDAD_ID SUBSECTOR_ACTIVIDAD_ID RAMA_ACTIVIDAD_ID
    SUBRAMA_ACTIVIDAD_ID EDIFICIO EDIFICIO_PISO Tipo_Asentamiento Fecha_Alta AreaGeo"""
)
MONTHLY_CRIME = _words(
    """ano cve_ent entidad cve_municipio municipio bien_juridico tipo_delito subtipo_delito modalidad
    enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"""
)
MONTHLY_CRIME_HEADER = {
    "año": "ano",
    "clave_ent": "cve_ent",
    "entidad": "entidad",
    "cve._municipio": "cve_municipio",
    "municipio": "municipio",
    "bien_jurídico_afectado": "bien_juridico",
    "tipo_de_delito": "tipo_delito",
    "subtipo_de_delito": "subtipo_delito",
    "modalidad": "modalidad",
    "sexo": "sexo",
    "rango_de_edad": "rango_edad",
    "enero": "enero",
    "febrero": "febrero",
    "marzo": "marzo",
    "abril": "abril",
    "mayo": "mayo",
    "junio": "junio",
    "julio": "julio",
    "agosto": "agosto",
    "septiembre": "septiembre",
    "octubre": "octubre",
    "noviembre": "noviembre",
    "diciembre": "diciembre",
}
DEATHS = _words(
    """ent_regis mun_regis tloc_regis loc_regis ent_resid mun_resid tloc_resid loc_resid ent_ocurr mun_ocurr tloc_ocurr
    loc_ocurr causa_def cod_adicio lista_mex sexo ent_nac afromex conindig lengua cve_lengua nacionalid nacesp_cve edad
    sem_gest gramos dia_ocurr mes_ocurr anio_ocur dia_regis mes_regis anio_regis dia_nacim mes_nacim anio_nacim cond_act
    ocupacion escolarida edo_civil tipo_defun ocurr_trab lugar_ocur par_agre vio_fami asist_medi cirugia natviole
    necropsia usonecrops encefalica donador sitio_ocur cond_cert derechohab embarazo rel_emba horas minutos capitulo
    grupo lista1 gr_lismex area_ur edad_agru complicaro dia_cert mes_cert anio_cert maternas ent_ocules mun_ocules
    loc_ocules razon_m dis_re_oax"""
)
INCOME_SURVEY = _words(
    """folioviv foliohog ubica_geo tam_loc est_socio est_dis upm factor clase_hog sexo_jefe edad_jefe educa_jefe
    tot_integ hombres mujeres mayores menores p12_64 p65mas ocupados percep_ing perc_ocupa ing_cor ingtrab trabajo
    sueldos horas_extr comisiones aguinaldo indemtrab otra_rem remu_espec negocio noagrop industria comercio servicios
    agrope agricolas pecuarios reproducc pesca otros_trab rentas utilidad arrenda transfer jubilacion becas donativos
    remesas bene_gob transf_hog trans_inst estim_alqu otros_ing gasto_mon alimentos ali_dentro cereales carnes pescado
    leche huevo aceites tuberculo verduras frutas azucar cafe especias otros_alim bebidas ali_fuera tabaco vesti_calz
    vestido calzado vivienda alquiler pred_cons agua energia limpieza cuidados utensilios enseres salud ambul_serv
    aten_hosp medic_prod transporte publico foraneo adqui_vehi mantenim refaccion combus comunica educa_espa educacion
    esparci paq_turist personales cuida_pers acces_pers otros_gas transf_gas percep_tot retiro_inv prestamos otras_perc
    ero_nm_viv ero_nm_hog erogac_tot cuota_viv mater_serv material servicio deposito prest_terc pago_tarje deudas
    balance otras_erog smg"""
)
#: 1-based positions in the labour survey file; names changed within a year, positions did not.
LABOUR_POSITIONS = {"ent": 11, "eda": 25, "fac_tri": 53, "clase1": 55, "clase2": 56, "ingocup": 97, "emp_ppal": 107}
POVERTY = _words(
    """clave_entidad entidad_federativa clave_municipio municipio poblacion pobreza pobreza_pob pobreza_e
    pobreza_e_pob pobreza_m pobreza_m_pob vul_car vul_car_pob vul_ing vul_ing_pob npnv npnv_pob ic_rezedu
    ic_rezedu_pob ic_asalud ic_asalud_pob ic_segsoc ic_segsoc_pob ic_cv ic_cv_pob ic_sbv ic_sbv_pob ic_ali
    ic_ali_pob carencias carencias_pob carencias3 carencias3_pob plp plp_pob plp_e plp_e_pob"""
)
SOCIAL_LAG = _words(
    """cve_ent entidad cve_mun_local municipio pob_total analfabeta_15ymas no_asisten_6a14 edu_basica_incompleta_15ymas
    sin_derechohab_salud piso_tierra sin_excusado sin_agua sin_drenaje sin_electricidad sin_lavadora sin_refrigerador
    irs_indice irs_grado irs_lugar_nacional"""
)
SOCIAL_LAG_TRACT = _words(
    """cvegeo pobtot vivpar_hab ind_analfabeta ind_no_escuela_6_14 ind_no_escuela_15_24 ind_basica_incompleta
    ind_sin_salud ind_hacinamiento ind_sin_agua ind_sin_excusado ind_sin_drenaje ind_sin_luz ind_piso_tierra
    ind_sin_lavadora ind_sin_refri ind_sin_telfijo ind_sin_celular ind_sin_compu ind_sin_internet grado"""
)
HEALTH_UNITS_REQUIRED = _words(
    """clues clave_de_la_entidad clave_del_municipio clave_de_la_localidad estatus_de_operacion clave_nivel_atencion
    latitud longitud"""
)
WELFARE = _words(
    """cveent entidad beneficiarios intervenciones dependencias padrones programas periodo periodo_cve trimestre anio
    fecha entidad_etiqueta entidad_etq"""
)
TRAFFIC = _words(
    """periodo estado carretera clave ruta punto_generador km te sc tdpa m a b c2 c3 t3s2 t3s3 t3s2r4 otros a1 b1 c k'
    d latitud longitud"""
)
TRAFFIC_RENAMES = {"k'": "k_prime"}
HOUSING_FINANCE = _words(
    """ano mes cve_ent entidad cve_mun municipio organismo modalidad destino tipo sexo edad_rango ingresos_rango
    vivienda_valor acciones monto"""
)
COMMERCIAL_CREDIT = _words(
    """ano mes cve_ent entidad cve_mun municipio modalidad linea_credito esquema intermediario_financiero sexo edad_rango
    ingresos_rango vivienda_valor poblacion_indigena zona monto acciones"""
)
#: Measures of the inclusion files; key and label columns stand before them.
INCLUSION_MUNICIPAL_NUMBERS = _words(
    """poblacion_total poblacion_adulta sucursales_bm sucursales_bd sucursales_socap sucursales_sofipo
    sucursales_total corresponsales_max cajeros_bm cajeros_bd cajeros_socap cajeros_sofipo cajeros_total tpv_bm
    tpv_bd tpv_socap tpv_sofipo tpv_total_eacp tpv_agregadores tpv_adq_no_banc tpv_total_ag_adq tpv_total
    puntos_acceso_sca cuentas_bm cuentas_bd cuentas_socap cuentas_sofipo cuentas_total creditos_bm creditos_bd
    creditos_socap creditos_sofipo creditos_total tx_tpv_bm tx_tpv_bd tx_tpv_socap tx_tpv_sofipo tx_tpv_total
    remesas_mdd remesas_per_capita g_cuentas_bm_m g_cuentas_bm_h g_cuentas_bm_b g_cuentas_bd_m g_cuentas_bd_h
    g_cuentas_bd_b g_cuentas_socap_m g_cuentas_socap_h g_cuentas_socap_b g_cuentas_sofipo_m g_cuentas_sofipo_h
    g_cuentas_sofipo_b g_cuentas_total_m g_cuentas_total_h g_cuentas_total_b g_creditos_bm_m g_creditos_bm_h
    g_creditos_bm_b g_creditos_bd_m g_creditos_bd_h g_creditos_bd_b g_creditos_socap_m g_creditos_socap_h
    g_creditos_socap_b g_creditos_sofipo_m g_creditos_sofipo_h g_creditos_sofipo_b g_creditos_total_m
    g_creditos_total_h g_creditos_total_b"""
)
INCLUSION_STATE_NUMBERS = _words(
    """poblacion_total poblacion_adulta sucursales_bm sucursales_bd sucursales_socap sucursales_sofipo
    sucursales_total corresponsales_max cajeros_bm cajeros_bd cajeros_socap cajeros_sofipo cajeros_total tpv_bm
    tpv_bd tpv_socap tpv_sofipo tpv_total_eacp tpv_agregadores tpv_adq_no_banc tpv_total_ag_adq tpv_total
    cuentas_bm cuentas_bd cuentas_socap cuentas_sofipo cuentas_total creditos_bm creditos_bd creditos_socap
    creditos_sofipo creditos_total sar_asignado sar_registrado sar_total seg_vida seg_pensiones seg_accidentes
    seg_danos_sin_autos seg_automoviles seg_total tx_tpv_bm tx_tpv_bd tx_tpv_socap tx_tpv_sofipo tx_tpv_total
    remesas_mdd condusef_ubicacion condusef_reclamaciones ac_inf_sucursales ac_inf_corresponsales ac_inf_cajeros
    ac_inf_tpv ac_inf_total_ag_adq ac_pf_captacion ac_pf_credito ac_pf_afore ac_pf_vida ac_pf_pensiones
    ac_pf_accidentes ac_pf_danos_sin_autos ac_pf_automoviles ac_mp_tx_tpv ac_mp_remesas ac_mp_ubicacion
    ac_mp_reclamaciones"""
)
INCLUSION_STATE_LABELS = _words("ac_inf_estado ac_pf_estado ac_mp_estado_a ac_mp_estado_b")
