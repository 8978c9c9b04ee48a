"""Declared schemas of the source files. Nothing is inferred at read time."""

HEADER = """
numeroControlePNCP string, anoCompra string, sequencialCompra string, numeroCompra string, processo string,
objetoCompra string, informacaoComplementar string, srp boolean,
modalidadeId string, modalidadeNome string, modoDisputaId string, modoDisputaNome string,
situacaoCompraId string, situacaoCompraNome string, valorTotalEstimado string, valorTotalHomologado string,
dataPublicacaoPncp string, dataAberturaProposta string, dataEncerramentoProposta string,
dataAtualizacaoGlobal string, dataAtualizacao string, dataInclusao string, linkSistemaOrigem string,
orgaoEntidade struct<cnpj: string, razaoSocial: string, poderId: string, esferaId: string>,
orgaoSubRogado struct<cnpj: string, razaoSocial: string>,
unidadeOrgao struct<ufSigla: string, ufNome: string, municipioNome: string, codigoIbge: string,
  codigoUnidade: string, nomeUnidade: string>
"""

HEADER_STRUCT = f"struct<{HEADER.strip()}>"

ENVELOPE = (
    f"data array<{HEADER_STRUCT}>, totalRegistros bigint, totalPaginas int, numeroPagina int, "
    "paginasRestantes int, empty boolean, segment_id bigint, requestedPage int, _corrupt_record string"
)

DOCUMENT = """
bid_id bigint, sequencialDocumento string, titulo string, tipoDocumentoNome string, tipoDocumentoDescricao string,
tipoDocumentoId string, statusAtivo boolean, url string, uri string, dataPublicacaoPncp string, cnpj string,
anoCompra string, sequencialCompra string, position bigint
"""

ITEM = """
bid_id bigint, numeroItem int, descricao string, materialOuServico string, materialOuServicoNome string,
valorUnitarioEstimado double, valorTotal double, quantidade double, unidadeMedida string,
orcamentoSigiloso boolean, itemCategoriaId int, itemCategoriaNome string, patrimonio string,
codigoRegistroImobiliario string, criterioJulgamentoId int, criterioJulgamentoNome string,
situacaoCompraItem int, situacaoCompraItemNome string, tipoBeneficio int, tipoBeneficioNome string,
incentivoProdutivoBasico boolean, dataInclusao string, dataAtualizacao string, temResultado boolean,
imagem int, ncmNbsCodigo string, ncmNbsDescricao string, informacaoComplementar string, page int
"""

CITY = "city_code string, city string, uf string, lat double, lon double"
MODALITY = "modality_id int, modality string, active boolean"
