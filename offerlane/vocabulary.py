"""Word lists and labels that matching and classification go by."""

# Name phrases of products that are not a single fragrance.
NON_PERFUME = (
    "gift set", "set regalo", "set", "discovery set", "fragrance set", "perfume set", "parfum set", "coffret", "coffret cadeau", "cofanetto",
    "bundle", "pack", "travel set", "kit", "duo", "trio", "mystery box", "gift box", "tester", "testeur", "sample", "shampoo", "shower gel",
    "body wash", "body lotion", "body cream", "body milk", "deodorant", "deo spray", "aftershave", "after shave", "body spray", "hair mist",
    "makeup", "cosmetics", "cosmetic", "skincare", "skin care", "cosmetici",
)

# Words that describe any product and are left out of a widened query.
IGNORED_WORDS = ("eau", "de", "parfum", "perfume", "edp", "edt", "extrait", "spray", "ml", "for", "by")

# Words that never name a product family.
GENERIC_WORDS = ("eau", "de", "parfum", "perfume", "edp", "edt", "edc", "extrait", "spray", "intense", "limited", "edition", "for", "men", "women", "homme", "femme", "unisex")

# Words that don't tell product lines apart.
LINE_WORDS = ("men", "man", "male", "homme", "herren", "women", "woman", "female", "femme", "damen", "uomo", "donna", "unisex", "unisexe", "perfume", "parfum", "by")

# Concentrations in the order in which they are looked for (normalised text).
CONCENTRATIONS = (
    ("Extrait de Parfum", r"\bextrait(?: de)? parfum\b|\bextrait\b"),
    ("Eau de Parfum", r"\beau de parfum\b|\bedp\b"),
    ("Eau de Toilette", r"\beau de toilette\b|\bedt\b"),
    ("Eau de Cologne", r"\beau de cologne\b|\bedc\b"),
    ("Parfum", r"\bparfum\b"),
)

# Concentrations that a name is compared without, and those that a product line is named without.
NAME_CONCENTRATIONS = ("eau de parfum", "eau de toilette", "eau de cologne", "extrait de parfum", "edp", "edt", "edc")
LINE_CONCENTRATIONS = ("eau de parfum", "eau de toilette", "extrait de parfum", "edp", "edt")

# Words for whom a product is, in the order in which they are looked for.
AUDIENCES = (
    ("men", ("men", "man", "homme", "uomo", "herren", "male")),
    ("women", ("women", "woman", "femme", "donna", "damen", "female")),
    ("unisex", ("unisex", "unisexe")),
)

# Rank of an availability in price order; others come last.
AVAILABILITY_RANK = {"in stock": 0, "available": 0, "out of stock": 1, "unknown": 2}

# Sizes at or below are samples unless the query names a size.
SMALL_ML = 10

# Labels before the price and before the size of the product that a page is about.
PRICE_LABELS = ("precio", "price", "prix", "preis")
SIZE_LABELS = ("tamaño", "tamano", "size", "taille", "formato", "volume")

# Words that mark a price as a former one (normalised text).
OLD_PRICE = (
    "regular price", "old price", "original price", "precio habitual", "precio anterior", "precio original", "prix habituel", "prix avant",
    "normalpreis", "streichpreis", "uvp",
)

# Words and attribute values of a control that puts a product into the cart.
PURCHASE_WORDS = (
    "añadir al carrito", "agregar al carrito", "comprar", "add to cart", "add-to-cart", "buy now", "ajouter au panier", "acheter",
    "in den warenkorb", "jetzt kaufen", "acquista", "aggiungi al carrello",
)
PURCHASE_MARKERS = (
    "add-to-cart", "add_to_cart", "addtocart", "add-cart", "product-add-to-cart", "product_add_to_cart", "buy-now", "buy_now", "purchase", "cart-add", "cart_add",
)

# What data on stock says.
SAYS_IN_STOCK = ("instock", "in stock")
SAYS_OUT_OF_STOCK = ("outofstock", "out of stock", "soldout", "sold out", "unavailable")
