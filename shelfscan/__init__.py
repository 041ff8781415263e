"""Page-to-catalogue engine: turns an archive of fetched web pages into product catalogues."""
