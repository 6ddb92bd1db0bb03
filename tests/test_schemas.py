from shelfspark import schemas as S


def test_column_orders():
    assert S.BORROWERS.names == ["id", "name", "email", "phone", "gender", "address", "postcode", "borrowerType", "expiryDate", "memberSince"]
    assert S.MEDIA.names == ["id", "title", "author", "type", "classification", "barcodes", "resourceBox"]
    assert S.LOANS.names == ["id", "barcode", "title", "checkoutDate", "dueDate", "borrowerName", "borrowerId"]


def test_id_comes_first_and_prefixes():
    assert all(t.names[0] == "id" for t in S.TABLES.values())
    assert S.ID_PREFIX == {"Borrowers": "B", "Media": "M", "Loans": "L"}


def test_classifications():
    assert len(S.PREFIX_CLASSIFICATIONS) + len(S.EXACT_CLASSIFICATIONS) == 34
