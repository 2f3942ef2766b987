"""More parts of xlsx packages for tests and round trips: drawings with pictures, pivot caches."""

from __future__ import annotations

from xml.sax.saxutils import escape, quoteattr

_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_DOC = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006/relationships"
_DRAW = 'xmlns:xdr="http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def relationships(links: list[tuple[str, str, str]]) -> str:
    """links: (id, type, target)."""
    return f'<Relationships xmlns="{_PACKAGE}">{"".join(f"<Relationship Id={quoteattr(i)} Type={quoteattr(f"{_DOC}/{kind}")} Target={quoteattr(to)}/>" for i, kind, to in links)}</Relationships>'


def drawing(number: int, pictures: list[tuple[int, int, str, str]]) -> dict[str, str]:
    """Members of a drawing; pictures: (row, col, name, media member below xl/media)."""
    anchors = "".join(
        f'<xdr:oneCellAnchor><xdr:from><xdr:col>{col}</xdr:col><xdr:colOff>0</xdr:colOff><xdr:row>{row}</xdr:row><xdr:rowOff>0</xdr:rowOff></xdr:from><xdr:pic><xdr:nvPicPr><xdr:cNvPr id="{k}" name={quoteattr(name)}/></xdr:nvPicPr>'
        f'<xdr:blipFill><a:blip xmlns:r="{_DOC}" r:embed="rId{k}"/></xdr:blipFill></xdr:pic></xdr:oneCellAnchor>'
        for k, (row, col, name, _) in enumerate(pictures)
    )
    return {
        f"xl/drawings/drawing{number}.xml": f"<xdr:wsDr {_DRAW}>{anchors}</xdr:wsDr>",
        f"xl/drawings/_rels/drawing{number}.xml.rels": relationships([(f"rId{k}", "image", f"../media/{m}") for k, (_, _, _, m) in enumerate(pictures)]),
    }


def _column(values: tuple, dictionary: dict | None) -> list[str]:
    """The items of a field in all records; entries are numbered as they come."""
    if dictionary is None:
        return ["<m/>" if v is None else f'<n v="{v!r}"/>' if type(v) is int or type(v) is float else _plain(v) for v in values]
    for v in values:
        if v is not None and v not in dictionary:
            dictionary[v] = len(dictionary)
    made = {v: f'<x v="{k}"/>' for v, k in dictionary.items()}
    return ["<m/>" if v is None else made[v] for v in values]


def _plain(value) -> str:
    if isinstance(value, bool):
        return f'<b v="{int(value)}"/>'
    if isinstance(value, (int, float)):
        return f'<n v="{value!r}"/>'
    if hasattr(value, "isoformat"):
        return f'<d v="{value.isoformat()}"/>'
    return "<e v=\"#REF!\"/>" if value == "#REF!" else f"<s v={quoteattr(value)}/>"


def pivot(number: int, name: str, fields: list[tuple[str, bool]], rows: list[tuple]) -> dict[str, str]:
    """Members of a pivot table and its cache; fields: (name, whether items are in a dictionary). A calculated and a grouped field
    stand between them that records know nothing of."""
    dictionaries = [{} if shared else None for _, shared in fields]
    items = [_column(values, d) for values, d in zip(zip(*rows), dictionaries)]
    records = "".join([f"<r>{''.join(own)}</r>" for own in zip(*items)])
    own = [f"<cacheField name={quoteattr(n)} numFmtId=\"0\"><sharedItems{f' count=\"{len(d)}\">' + ''.join(map(_plain, d)) + '</sharedItems>' if d else '/>'}</cacheField>" for (n, _), d in zip(fields, dictionaries)]
    own.insert(1, f'<cacheField name="calculated" numFmtId="0" formula={quoteattr(escape("a*2"))} databaseField="0"/>')
    own.insert(3, '<cacheField name="grouped" numFmtId="0" databaseField="0"><fieldGroup base="0"><groupItems count="1"><s v="all"/></groupItems></fieldGroup></cacheField>')
    return {
        f"xl/pivotTables/pivotTable{number}.xml": f'<pivotTableDefinition xmlns="{_MAIN}" name={quoteattr(name)} cacheId="{number}"/>',
        f"xl/pivotTables/_rels/pivotTable{number}.xml.rels": relationships([("rId1", "pivotCacheDefinition", f"../pivotCache/pivotCacheDefinition{number}.xml")]),
        f"xl/pivotCache/pivotCacheDefinition{number}.xml": f'<pivotCacheDefinition xmlns="{_MAIN}" xmlns:r="{_DOC}" r:id="rId1"><cacheFields>{"".join(own)}</cacheFields></pivotCacheDefinition>',
        f"xl/pivotCache/_rels/pivotCacheDefinition{number}.xml.rels": relationships([("rId1", "pivotCacheRecords", f"pivotCacheRecords{number}.xml")]),
        f"xl/pivotCache/pivotCacheRecords{number}.xml": f'<pivotCacheRecords xmlns="{_MAIN}" count="{len(rows)}">{records}</pivotCacheRecords>',
    }
