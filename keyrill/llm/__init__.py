"""Operations of large training-data pipelines. Nothing else imports this package."""
