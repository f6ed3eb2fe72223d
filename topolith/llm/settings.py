"""Parameters of the registered queries and of the pipeline."""

#: The key of pseudonyms; a deployment passes its own secret.
PII_KEY = "topolith-example-key"

#: Where this box has the public vocabulary; read on the driver only.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
