"""Dimensions and word lists: fixed values, on which results depend."""

from __future__ import annotations

#: Evaluation types in report order: identifier, label, gold column.
TYPES = (
    ("nome", "Nome(s)", "nomes"),
    ("local", "Localizações (s)", "locais"),
    ("documento", "Documento(s)", "documentos"),
    ("placa", "Emplacamento (s)", "placas"),
    ("telefone", "Telefone (s)", "telefones"),
    ("email", "Email (s) e contas (ex: instagram)", "emails"),
    ("viatura", "N° da VTR", "viaturas"),
    ("vulgo", "Vulgo(s)/Apelido(s)", "vulgos"),
)
#: Categories of extracted entities, in order, with their placeholder and type.
CATEGORIES = (
    ("nomes", "NOME", "nome"),
    ("locais", "LOCAL", "local"),
    ("estabelecimentos", "ESTABELECIMENTO", "local"),
    ("vulgos", "VULGO", "vulgo"),
)
#: Type of each detector label; labels of institutional hygiene have none.
LABEL_TYPES = {
    "ENDERECO": "local", "CEP": "local", "COORDENADA": "local",
    "CPF": "documento", "RG": "documento", "CNH": "documento", "IMEI": "documento", "REG_PROF": "documento",
    "PLACA": "placa", "TELEFONE": "telefone",
    "EMAIL": "email", "REDE_SOCIAL": "email", "URL": "email", "VIATURA": "viatura",
}
HYGIENE = ("BO", "PROCESSO", "PROTOCOLO", "INQUERITO", "OFICIO", "CODIGO", "DATA")
#: Labels counted by the validation rule.
COUNTED = (
    "TELEFONE", "EMAIL", "REDE_SOCIAL", "URL", "PROCESSO", "PROTOCOLO", "BO", "INQUERITO", "OFICIO", "CODIGO", "CPF",
    "RG", "CNH", "IMEI", "REG_PROF", "DATA", "VIATURA", "PLACA", "CEP", "ENDERECO",
)

# Results depend on these very words. All are compared in lower case.
NAMES_EXCLUDED = """
ele ela eu mim nós eles elas dele dela me te se nos lhe lhes si
vítima vitima vítimas vitimas autor autora autores autor1 autor2 declarante comunicante noticiante requerente requerido
indiciado indiciada averiguado averiguada suspeito suspeita suspeitos suspeitas acusado acusada investigado investigada
meliante meliantes infrator infratora criminoso criminosos assaltante assaltantes ladrão ladrao roubador agente agentes
indivíduo individuo indivíduos individuos cidadão cidadao cidadã cidada cidadãos rapaz homem mulher moça moca pessoa
pessoas transeunte pedestre abordado abordada abordados comparsa comparsas capanga compartícipe carona garupa piloto
condutor condutora motorista passageiro passageira ocupante ocupantes menor menores adolescente adolescentes criança
crianca testemunha testemunhas denunciante
policial policiais guarnição guarnicao equipe viatura delegado delegada escrivão escrivao escrivã investigador
investigadora inspetor inspetora comandante soldado sargento cabo tenente capitão capitao guarda gcm pm vigilante
segurança seguranca porteiro
senhor senhora sr sra dona dr dra
filho filha mãe mae pai irmão irmã irmao irma tio tia primo prima avô avó avo neto neta marido esposa esposo companheiro
companheira namorado namorada sogro sogra cunhado cunhada amigo amiga vizinho vizinha colega patrão patrao
""".split() + ["autor 1", "autor 2", "autor 01", "autor 02", "primeiro autor", "segundo autor"]
PLACES_EXCLUDED = """
casa residência residencia domicílio domicilio apartamento apto imóvel imovel condomínio condominio prédio predio
edifício edificio quarto sala cozinha banheiro quintal garagem varanda portaria estacionamento rua avenida travessa
alameda viela beco estrada rodovia calçada calcada esquina praça praca parque jardim terminal ponto semáforo semaforo
cruzamento hospital pronto-socorro ps ubs upa delegacia dp plantão plantao batalhão batalhao quartel escola creche
faculdade universidade igreja bar boteco lanchonete restaurante padaria mercado supermercado farmácia farmacia loja
lojas comércio comercio oficina salão salao academia motel hotel posto shopping agência agencia banco caixa
estabelecimento trabalho serviço servico firma empresa escritório via local
""".split() + [
    "via pública", "via publica", "ponto de ônibus", "ponto de onibus", "pronto socorro", "posto de gasolina",
    "comércio local", "estabelecimento comercial",
]
BRANDS_EXCLUDED = """
iphone samsung galaxy motorola xiaomi redmi nokia lg apple asus positivo multilaser honda yamaha suzuki fiat volkswagen
vw chevrolet gm ford toyota hyundai renault nissan jeep cg cb biz fan titan pop corinthians palmeiras santos
""".split() + ["moto g", "são paulo"]
PLACEHOLDER_WORDS = """
NOME LOCAL ESTABELECIMENTO VULGO TELEFONE EMAIL REDE_SOCIAL URL PROCESSO PROTOCOLO BO INQUERITO OFICIO CODIGO CPF RG CNH
IMEI REG_PROF DATA VIATURA PLACA CEP ENDERECO
""".split()
#: Labels of extractors by category; a B- or I- prefix is cut off first.
RAW_LABELS = {
    "PER": "nomes", "PERSON": "nomes", "PESSOA": "nomes", "NRP": "nomes",
    "LOC": "locais", "GPE": "locais", "LOCAL": "locais", "LOCALIZACAO": "locais", "LOCATION": "locais",
    "ORG": "estabelecimentos", "ORGANIZACAO": "estabelecimentos", "ORGANIZATION": "estabelecimentos",
}
#: Kinship and generic descriptions, searched in names.
KINSHIP = (
    r"^(meu|minha|meus|minhas|seu|sua|seus|suas|nosso|nossa)\b",
    r"^ex[\s\-]",
    r"^(autor|indiv[íi]duo|suspeito|comparsa|elemento)\s*\d+$",
    r"^(primeiro|segundo|terceiro)\s+(autor|indiv[íi]duo|suspeito)$",
)
#: Words that make a listed document an institutional code.
INSTITUTIONAL = r"\b(?:IML|NOC|BOPM|BO|RE|processo|CNJ|boletim|of[íi]cio|inqu[ée]rito|protocolo)\b"
